import math
import re

import pytest

from docloom.llm import licenses as li

from .fixtures import DOCS, awkward, words


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, wanted):
    """Places of phrases, and (template, block) of all blocks that meet one, by trying every block with every template."""
    w = plain(text)
    places = sorted((t.label, i) for t in wanted if t.phrase for p in [[x.decode() for x in t.words]] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)
    blocks = set()
    for t in wanted:
        width = 48
        while width // 2 < len(t.words):
            width *= 2
        for at in range(0, (max(0, math.ceil((len(w) - width) / (width // 2))) + 1) * (width // 2), width // 2):
            if not t.phrase and len(set(w[at : at + width]) & {x.decode() for x in t.words}) >= t.least:
                blocks.add((b" ".join(t.words).decode(), at))
    return len(w), places, blocks


def texts():
    notice = [*li.PHRASES, *li.TEMPLATES]
    out = [r[1] for r in awkward()]
    for i, n in enumerate(notice):
        out.append(words(i * 7, i) + " " + n.upper() + ", " + words(90 - i, i + 1) + " " + n.replace(" ", "-") + " " + n)
    out.append(" ".join(notice * 3))
    out.append("licensed under cc by sa 4.0 and Licensed Under CC BY-NC 4.0")
    return out


def test_scan_is_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    wanted = li.templates()
    for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = r.n_words, sorted((p.label, p.first_word) for p in r.places), {(b.template, b.first_word) for b in r.blocks}
        assert found == brute(rows[r.doc_id][1], wanted)


def test_lower_thresholds_lose_no_block():
    wanted = li.templates(threshold=0.6)
    vocabulary = sorted({w for t in wanted for w in t.words})
    for counts in ({}, {w: i * 7 % 31 for i, w in enumerate(vocabulary)}):
        index = li.Index(wanted, counts)
        for t in texts():
            n, places, blocks = index.scan(t)
            assert (n, sorted((p["label"], p["first_word"]) for p in places), {(b["template"], b["first_word"]) for b in blocks}) == brute(t, wanted)


@pytest.mark.parametrize("rows", [awkward(), []], ids=["awkward", "empty"])
def test_awkward_tables(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(*r, [1]) for r in rows], DOCS + ", labels array<int>")
    monkeypatch.setattr(li, "table", lambda *a: docs)
    found = {r.doc_id: r for r in li.op1_license_blocks(spark, "").collect()}
    assert len(found) == len({r[0] for r in rows})
    if rows:
        assert (found[9].n_base, found[9].base_labels, found[9].labels, found[9].score) == (2, "apache-2,mit", "apache-2,mit", 1.0)
        assert (found[0].n_words, found[0].first_word, found[0].labels, found[0].score) == (0, None, "", 0.0)


def test_templates_of_any_length(spark):
    """Whole license texts, cut anywhere, and templates up to 400 words; those without words are refused."""
    notice = max(li.TEMPLATES, key=len)
    long = {words(n, n, "abcdefghijklmnopqrstuvwxyz"): f"t{n}" for n in (24, 25, 48, 49, 100, 400)}
    wanted = li.templates(0.8, long | {notice: "mit"})
    assert [t.width for t in wanted if not t.phrase] == [48, 96, 96, 192, 384, 1536, 384]
    rows = [(i, words(i * 37, i) + " " + t + " " + words(50, i)) for i, t in enumerate([*long, notice, notice.upper()])]
    rows.append((99, " ".join([*long, notice] * 2)))
    for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string"), wanted).collect():
        n, places, blocks = brute(dict(rows)[r.doc_id], wanted)
        assert {(b.template, b.first_word) for b in r.blocks} == blocks and len(blocks) >= 1
    with pytest.raises(ValueError):
        li.templates(texts={" !": "x"})


def test_a_block_keeps_all_templates_it_meets():
    """A dual notice has both labels though the words of one are among those of the other."""
    index = li.Index(li.templates(), {})
    found = index.scan("Under the GNU General Public License version 3 or the GNU Lesser General Public License version 3.")[2]
    assert {b["label"] for b in found} >= {"gpl-3", "lgpl-3"}
