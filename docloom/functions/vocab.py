"""Labels, stop words, prefixes and character sets of the report forms.

The lists differ by rule set on purpose; order matters where words are removed or tried one by one.
"""

NAME_LABELS = ["工程名称", "项目名称"]
CODE_LABELS = ["工程编号", "项目编号", "编号"]
NAME_KEYS = ["工程名称", "项目名称", "工程项目名称"]
LABEL_NOISE = ["工程名称", "项目名称", "工程编号", "编号"]
PHRASE_NOISE = ["我方完成", "项目开工前的各项准备工作", "项目开工前", "各项准备工作", "申请批准", "计划于", "工程名称", "项目名称", "工程编号", "项目编号"]
PHRASE_STOPS = ["施工单位", "建设单位", "监理单位", "验收日期", "开工日期", "竣工日期", "项目编号", "工程编号"]
AREA_STOPS = ["建设单位", "施工单位", "监理单位", "验收日期", "负责人", "开工日期", "工程编号", "项目编号"]
LINE_STOPS = ["施工单位", "建设单位", "监理单位", "验收日期"]
NAME_STOPS = ["施工单位", "建设单位", "监理单位", "验收日期", "开工日期", "竣工日期"]
REGION_WORDS = ["项目名称", "工程名称", "项目编号", "工程编号"]
JOIN_STOPPERS = ["工程编号", "项目编号", "工程名称", "项目名称"]
PAGE_WORDS = {"project_name": ["项目名称", "工程名称"], "project_code": ["项目编号", "工程编号", "编号"]}
PAIR_KEYS = {"project_name": ["项目名称", "工程名称"], "project_code": ["项目编号", "工程编号"]}
TEMPLATE_WORDS = {"startup": ["开工报告", "我方完成", "开工前"], "completion": ["竣工验收报告", "工程编号", "工程名称", "验收日期"]}
WORK_WORDS = ["工程", "线路", "改造", "大修", "优化", "迁改"]
START_PHRASES = ["我方完成", "项目开工前"]
CODE_PREFIXES = ["B113", "C513", "181320", "5Z"]
FILE_CHARS = '<>:"/\\|?*'
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff"]
NARROW_SUFFIXES = [".jpg", ".jpeg", ".png"]
COLONS = "：:"
NAME_EDGES = "：:，,。"
SHEET_HEADINGS = ["原文件", "工程名称", "工程编号", "新文件名", "状态"]
UNKNOWN_REASON, WAITING = "无法识别工程信息", "等待OCR"
DONE_FOLDER, FAILED_FOLDER = "已重命名图片", "未识别"
RESULT_SHEET, RENAME_SHEET = "处理结果", "重命名记录"

#: What Python's str.strip removes, as characters and as a character class that Java and RE2 both read.
BLANK_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

OPEN_PATTERNS = [r"我方完成([^\n]+?)项目开工前", r"我方完成([^\n]+?)开工前的", r"我方完成([^\n]+?)，?项目开工"]
COMPLETION_PATTERNS = [rf"{label}([^\n]+?)(?:工程编号|编号|建设单位|施工单位)" for label in NAME_LABELS]
CODE_PATTERNS = [rf"{label}([A-Za-z0-9\-_]+)" for label in CODE_LABELS]
SENTENCE_PATTERN = rf"(?:我方完成|完成)[{BLANKS}]*([^，。\n]+?(?:工程|线路|改造|大修|优化))"
SERIAL_PATTERNS = [r"[A-Z]\p{Nd}{6,}[A-Z0-9-]*", r"\p{Nd}{8,}[A-Z0-9-]*"]
LONG_CODE, DASHED_CODE = r"[A-Za-z0-9]{6,}", r"[A-Za-z0-9-]{5,}"
