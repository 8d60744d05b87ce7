"""Fixed values that results depend on."""

# BM25 and fusion.
K1 = 1.2
B = 0.75
TEXT_BONUS = 3.0
TITLE_BONUS = 5.0
RRF_K = 60
HITS_PER_VERSION = 3
RERANK_POOL = 80
#: Profile -> weights of the channels.
PROFILES = {
    "exact_reference": {"vector": 0.30, "bm25": 0.60, "catalog": 0.10},
    "multi_aspect": {"vector": 0.45, "bm25": 0.35, "catalog": 0.20},
    "semantic": {"vector": 0.55, "bm25": 0.35, "catalog": 0.10},
}
#: Words that are no tokens.
STOP_WORDS = ("的", "了", "和", "是", "在", "请", "如何", "什么", "怎么", "是否", "一个", "有哪些", "应该", "进行")
#: Patterns of the question classes, tried in this order.
EXACT_PATTERN = "第[一二三四五六七八九十百\\d]+条|[《\"“].{3,}[》\"”]|文号|原文|条款"
ASPECT_PATTERN = "区别|比较|分别|流程|全过程|如何处理|怎么处理|步骤|凭证|分录"

# Closures.
DEPENDENCY_DEPTH = 8
INVALIDATION_DEPTH = 9

# Jobs and retention.
RETRY_DELAYS = (30, 120, 600)
RECOVERY_BATCH = 500
IDEMPOTENCY_HOURS = 24
GAP_RUNS = 500

TITLE_SIMILARITY = 0.82
EFFECTIVE_OFFSET = "+08:00"

# Phrases and words that carry no subject, for the terms that reading plans discover pages by.
DISCOVERY_STOPS = ("有哪些", "为什么", "怎么样", "如何", "怎么", "什么", "是否", "请问", "分别", "以及", "同时", "应该", "需要", "进行", "有关", "相关")
DISCOVERY_STOP_CHARACTERS = "的了是在和与及或等请吗呢"
DISCOVERY_STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "is", "are", "how", "what", "which", "please")
ACTION_PHRASES = (
    "过程中", "过程", "业务", "估值", "定值", "处理", "核算", "会计", "计量", "测算", "计算", "操作", "流程", "方法", "标准", "指引", "准则", "规则", "规定", "实务", "事项", "问题", "情况", "场景",
    "具体", "详细", "说明", "介绍", "确定", "确认", "关于", "对于", "针对", "涉及", "应当", "应如何",
)
#: A star stands for any ending.
ACTION_WORDS = ("business", "valu*", "accounting", "treatment", "process*", "handl*", "measur*", "calculat*", "method*", "standard*", "guidance", "rule*", "operation*", "explain", "describe")
ROUTER_STOPS = ("如何", "怎么", "什么", "哪些", "是否", "请问", "应当", "需要", "进行", "处理", "流程", "规则", "方法")
ROUTER_STOP_WORDS = ("how", "what", "which", "the", "and", "with", "for", "from", "does", "should", "please")

# What parts a question into facets, and how much of its subject makes a page strong: CJK places or Latin words with a share, a long CJK term, a single Latin word.
FACET_BREAKS = "[、，,；;。！？!?\\n]|以及|同时|分别|[和与及]|\\band\\b"
STRONG_PLACES, STRONG_WORDS, STRONG_SHARE = 4, 2, 0.2
STRONG_LENGTH, STRONG_LENGTH_SHARE, STRONG_WORD_SHARE = 3, 0.18, 0.3
FACET_SHARE = 0.5
