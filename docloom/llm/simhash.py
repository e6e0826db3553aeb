"""Document fingerprints by SimHash (DataFrame functions only).

A text's terms are its shingles of five words (the whole sequence if there are fewer words), weighted
by how often they occur. Each term's 64-bit hash votes on every bit, for 1 or for 0, with its weight,
and the majority decides (a tie is 0).

Permuted block tables find all pairs of fingerprints within a Hamming radius r: cut into r + d blocks,
two such fingerprints agree in at least d blocks, so each goes into one table per choice of d blocks,
keyed by those, and rows of equal key are compared. Fingerprints are made distinct first, so copies of
a text never meet each other.

Defined results: null and empty texts have no terms and the fingerprint 0; a null id sorts as the
least; rows of equal id are ordered by a hash of their texts (rows equal in both lie in one window,
which spills); the only row of a table is its own next; a text of any length is fingerprinted whole, its
terms made inside one task. An empty table gives an empty result. Extra columns don't matter: only id
and text are read.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import plain_unions, spread_join
from .common import listed, table, text_of, written

#: Words of a term, and terms that are summed up at a time: a byte's count and its sign must hold them.
WIDTH, RUN = 5, 127
#: Hamming radius of the pair search, and how many blocks must agree.
RADIUS, AGREE = 3, 3
#: Rows that one neighbour window holds, about. The driver holds an id per window, so there are so many
#: windows at most: beyond 67 million rows they grow with the input, and spill.
WINDOW_ROWS, MOST_WINDOWS = 1024, 1 << 16
#: Fingerprints that share a block table's key are paired up if about so many do at most.
MOST_PAIRED = 8192


def fingerprint_of(lanes: list[Column], total: Column) -> Column:
    """The 64 bits from the 32 sums: the lower half of sum k counts bit k, the upper half bit k + 32."""
    out = F.lit(0).cast("long")
    for k, lane in enumerate(lanes):
        low, high = lane.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(lane, 32)
        out = out.bitwiseOR(F.when(low * 2 > total, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        out = out.bitwiseOR(F.when(high * 2 > total, F.lit((1 << (k + 32)) - (1 << 64 if k == 31 else 0))).otherwise(F.lit(0)).cast("long"))
    return out


#: White space between words.
BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Words between white space; none of a blank text."""
    plain = reduce(lambda x, blank: F.replace(x, F.lit(blank), F.lit(" ")), BLANKS[1:], text)
    return F.array_remove(F.split(plain, " "), "")  # no pattern: a split by one character needs none


def terms_in(words: Column, whole: Column) -> Column:
    """How many terms start in the words; if they are the `whole` text, fewer words than a term make one."""
    return F.greatest(F.size(words) - (WIDTH - 1), F.when(whole, F.least(F.size(words), F.lit(1))).otherwise(F.lit(0)))


def voted(rows: DataFrame, keys: list[str], text: str, edited: str) -> DataFrame:
    """The keys, fp and efp: the fingerprints of two texts of a row that begin alike; efp is null where `edited` is.

    The texts' words are cut at `_head`, the characters that both begin with: terms within the words that
    end there are hashed once and count for both texts. Terms are generated inside each row and summed
    up where the rows lie, RUN of them at a time, so that a byte of a sum holds a bit's count and eight
    sums hold all 64; those go into one row of 32 sums of two bits each for either text.
    """
    rows = rows.select(*keys, text, edited, "_head", words_of(F.substring(text, F.lit(1), F.col("_head"))).alias("_w"))
    open_ = (F.size("_w") > 0) & ~F.substring(text, F.col("_head"), F.lit(1)).isin(*BLANKS)  # the last word may go on
    rows = rows.select(*keys, text, edited, "_head", F.slice("_w", F.lit(1), F.size("_w") - open_.cast("int")).alias("_w"), F.when(open_, F.get("_w", F.size("_w") - 1)).otherwise("").alias("_part"))
    rest = lambda c: words_of(F.concat("_part", F.substring(c, F.col("_head") + 1, F.length(c))))
    rows = rows.select(*keys, F.col(edited).isNotNull().alias("_two"), "_w", rest(text).alias("_a"), F.when(F.col(edited).isNotNull(), rest(edited)).otherwise(F.array().cast("array<string>")).alias("_b"))
    last = F.slice("_w", F.greatest(F.size("_w") - (WIDTH - 2), F.lit(1)), F.lit(WIDTH - 1))
    whole = F.size("_w") < WIDTH
    rows = rows.select(*keys, "_two", "_w", whole.alias("_whole"), F.greatest(F.size("_w") - (WIDTH - 1), F.lit(0)).alias("_nw"), F.concat(last, "_a").alias("_a"), F.concat(last, "_b").alias("_b"))
    rows = rows.select(*keys, "_w", "_a", "_b", "_nw", terms_in(F.col("_a"), F.col("_whole")).alias("_na"), F.when(F.col("_two"), terms_in(F.col("_b"), F.col("_whole"))).otherwise(0).alias("_nb"))
    count = F.col("_nw") + F.col("_na") + F.col("_nb")
    rows = rows.select(*keys, "_w", "_a", "_b", "_nw", "_na", F.explode_outer(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("_i"))
    side = F.when(F.col("_i") < F.col("_nw"), 0).when(F.col("_i") < F.col("_nw") + F.col("_na"), 1).otherwise(2)
    rows = rows.select(*keys, "_w", "_a", "_b", "_i", "_nw", "_na", side.alias("_v"))
    words = F.when(F.col("_v") == 0, F.col("_w")).when(F.col("_v") == 1, F.col("_a")).otherwise(F.col("_b"))
    first = F.col("_i") - F.when(F.col("_v") == 0, 0).when(F.col("_v") == 1, F.col("_nw")).otherwise(F.col("_nw") + F.col("_na"))
    rows = rows.select(*keys, "_v", "_i", words.alias("_t"), first.alias("_j"))
    term = F.xxhash64(*[F.get("_t", F.col("_j") + k) for k in range(WIDTH)])
    rows = rows.select(*keys, "_v", F.floor(F.col("_j") / RUN).alias("_run"), F.when(F.col("_i").isNotNull(), term).alias("_h"))
    ones = F.lit(0x0101010101010101)
    sums = rows.groupBy(*keys, "_v", "_run").agg(F.count("_h").alias("_n"), *[F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(ones)).alias(f"_s{k}") for k in range(8)])
    two = lambda k: F.shiftrightunsigned(f"_s{k % 8}", k // 8 * 8).bitwiseAND(F.lit(0xFF000000FF))  # noqa: E731  bits k and k + 32
    sides = {"fp": F.col("_v") != 2, "efp": F.col("_v") != 1}
    found = sums.groupBy(*keys).agg(*[F.sum(F.when(on, two(k))).alias(f"_{n}{k}") for n, on in sides.items() for k in range(32)], *[F.sum(F.when(on, F.col("_n"))).alias(f"_{n}") for n, on in sides.items()])
    return found.select(*keys, *[fingerprint_of([F.coalesce(f"_{n}{k}", F.lit(0)) for k in range(32)], F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sides])


def _count_upto(rows: DataFrame, bounds: list[int], value: Column, out: str) -> DataFrame:
    """The rows with the number of bounds (rising) that are at most the value, by halving."""
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    rows = rows.withColumn(out, F.lit(0))
    for k in reversed(range(len(bounds).bit_length())):
        rows = rows.withColumn(out, F.col(out) + F.when(F.get(known, F.col(out) + ((1 << k) - 1)) <= value, 1 << k).otherwise(0))
    return rows


def neighbour_windows(docs: DataFrame) -> DataFrame:
    """Rows with `_bucket` and `_copy`, so that ordering a bucket by (_copy, falling id, the text's hash) has each row's next one after it.

    Buckets are ranges of ids of about equal count; an id of very many rows is cut into ranges of their
    texts' hashes. The first row of each goes also, as a copy, to the end of the bucket before it, and
    that of the first to the end of the last.
    """
    whole = F.col("doc_id").cast("long").alias("doc_id")
    stats = docs.select(whole).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).collect()[0]
    least = max(-(1 << 63), (stats.low or 0) - 1)
    value = F.coalesce("doc_id", F.lit(least))
    levels = max(1, min(MOST_WINDOWS, round(stats.n / WINDOW_ROWS)))
    cuts = docs.select(whole).agg(F.percentile_approx(value, [i / levels for i in range(1, levels)], 16 * levels).alias("q")).collect()[0].q if levels > 1 else []
    times = Counter(cuts or [])
    bounds = sorted(times)
    hot = any(n > 1 for n in times.values())
    tie = F.xxhash64(text_of()) if hot else F.lit(0).cast("long")

    def bucketed(rows: DataFrame) -> DataFrame:
        rows = _count_upto(rows, bounds, value, "_k")
        if not hot:
            return rows.withColumn("_bucket", F.col("_k").cast("long")).drop("_k")
        known, many = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (bounds, [times[x] for x in bounds]))
        rows = rows.withColumn("_many", F.when(F.get(known, F.col("_k") - 1) == value, F.get(many, F.col("_k") - 1)).otherwise(1))
        part = F.least(F.col("_many") - 1, F.floor((F.col("_tie") / 2.0**64 + 0.5) * F.col("_many")))
        return rows.withColumn("_bucket", F.col("_k") * F.lit(2 + max(times.values())) + F.when(F.col("_many") > 1, 1 + part).otherwise(0)).drop("_k", "_many")

    firsts = bucketed(docs.select(whole, tie.alias("_tie"))).groupBy("_bucket").agg(F.max(F.struct("doc_id", (-1 - F.col("_tie")).alias("t"))).alias("f")).collect()
    firsts = sorted(firsts, key=lambda r: (r.f.doc_id is None, -(r.f.doc_id or 0), -r.f.t))
    ends = listed(docs.sparkSession, _head=[r.f.doc_id for r in firsts], _headed=[-1 - r.f.t for r in firsts], _to=[firsts[i - 1]._bucket for i in range(len(firsts))])
    rows = bucketed(docs.select(whole, text_of().alias("text"), tie.alias("_tie")))
    rows = rows.withColumnRenamed("_bucket", "_own").join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("_tie") == F.col("_headed")), "left")
    at = lambda bucket, copy: F.struct(F.col(bucket).alias("_bucket"), F.lit(copy).alias("_copy"))
    return rows.select("doc_id", "text", F.inline(F.when(F.col("_to").isNull(), F.array(at("_own", 0))).otherwise(F.array(at("_own", 0), at("_to", 1)))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def with_edits(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint beside those of its edited text and of the next row.

    Texts are shuffled once, into the neighbour windows; fingerprints are summed up and compared there.
    """
    order = [F.col("_copy"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    w = Window.partitionBy("_bucket").orderBy(*order)
    rows = neighbour_windows(docs)
    rows = rows.select("_bucket", "_copy", "doc_id", "text", F.lead("text").over(w).alias("_next"), F.row_number().over(w).alias("_pos"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    own = F.col("_copy") == 0
    edited = F.when(own, F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut)))
    rows = rows.select("_bucket", "_copy", "_pos", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("_edited"), (n - cut).alias("_head"))
    rows = rows.withColumn("edited_sha256", F.unhex(F.sha2(F.encode("_edited", "UTF-8"), 256)))
    found = voted(rows, ["_bucket", "_copy", "_pos", "doc_id", "n_chars", "edited_sha256"], "text", "_edited")
    found = found.withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))
    found = found.withColumn("nfp", F.lead("fp").over(Window.partitionBy("_bucket").orderBy("_pos")))
    return found.where("_copy = 0").select("doc_id", "n_chars", "edited_sha256", "fp", "efp", "nfp")


def block_tables(fps: DataFrame, radius: int = RADIUS, agree: int = AGREE) -> DataFrame:
    """Rows (fp, table, key) of distinct fingerprints, one for each choice of blocks."""
    count = radius + agree
    cuts = [64 * i // count for i in range(count + 1)]
    parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    rows = [F.struct(F.lit(i).alias("table"), F.xxhash64(*[parts[p] for p in chosen]).alias("key")) for i, chosen in enumerate(combinations(range(count), agree))]
    return fps.select("fp", F.inline(F.array(*rows)))


def flips(spark: SparkSession, radius: int = RADIUS, agree: int = AGREE) -> DataFrame:
    """Rows (table, flip): for each block table all ways to change up to `radius` bits outside its key, some 110,000 in all."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(F.col("id") / 64**k), F.lit(64)).cast("int")) for k in range(radius)]
    masks = spark.range(64**radius).select(reduce(Column.bitwiseOR, bits).alias("flip")).distinct()
    cuts = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [signed(sum((1 << cuts[p + 1]) - (1 << cuts[p]) for p in chosen)) for chosen in combinations(range(radius + agree), agree)]
    return masks.select("flip", F.inline(F.array(*[F.struct(F.lit(i).alias("table"), F.lit(k).cast("long").alias("k")) for i, k in enumerate(keys)]))).where(F.col("flip").bitwiseAND(F.col("k")) == 0).select("table", "flip")


def near_pairs(fps: DataFrame, radius: int = RADIUS, agree: int = AGREE) -> DataFrame:
    """All pairs (a, b, distance), a < b, of distinct fingerprints within the radius.

    Rows of a table's key are paired up where few share it. Keys are counted in cells, which are few and
    summed up where the rows lie; for rows of cells that hold many, the fingerprints that differ from
    theirs in up to `radius` bits outside the key are made and looked up, a number that doesn't depend
    on how many share the key. So the work per fingerprint is bounded, however large a group is.
    """
    fps = fps.select("fp").distinct()
    tables = block_tables(fps, radius, agree)
    cells = max(1 << 12, fps.count() * 8 // MOST_PAIRED)
    tables = tables.withColumn("cell", F.pmod("key", F.lit(cells)))
    crowded = tables.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_PAIRED).select(F.col("table").alias("_t"), F.col("cell").alias("_c"))
    crowded = written(crowded, "crowded")
    some = crowded.count() > 0
    few = tables.join(crowded, (F.col("table") == F.col("_t")) & (F.col("cell") == F.col("_c")), "left_anti") if some else tables
    left, right = few.select("table", "key", F.col("fp").alias("a")), few.select("table", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["table", "key"]).where("a < b").select("a", "b")
    if some:
        many = tables.join(crowded, (F.col("table") == F.col("_t")) & (F.col("cell") == F.col("_c")), "left_semi")
        made = many.join(F.broadcast(flips(fps.sparkSession, radius, agree)), "table").select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("flip")).alias("b")).where("a < b")
        pairs = pairs.unionAll(made.join(fps, F.col("b") == F.col("fp"), "left_semi"))
    pairs = pairs.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int").alias("distance"))
    return pairs.where(F.col("distance") <= radius).distinct()


def near_counts(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """_fp and n_near: how many other fingerprints lie within the radius, for those that have any."""
    pairs = near_pairs(fps, radius)
    return pairs.select(F.explode(F.array("a", "b")).alias("_fp")).groupBy("_fp").agg(F.count(F.lit(1)).alias("n_near"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, how like it the edited text and the next document are, and how many other fingerprints are near."""
    plain_unions(spark)
    found = written(with_edits(table(spark, sf_dir, "documents")), "fingerprints")
    found = spread_join(found, near_counts(found.select("fp")), "fp", "_fp", ["doc_id"], "left")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return found.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("efp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
