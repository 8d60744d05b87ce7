"""Wordings that question plans and passages of answers go by."""

# What a question is about, and the facets that a passage may show.
PURCHASE = "买入|购买|买进|购入|买股票|买债券|购置|取得|申购"
POSTING = "入账|记账|账务|会计|分录|核算|计量|交易费用|手续费"
VALUATION = "估值|公允价值|取价|市值|估值日"
VALIDITY = "现行|最新|有效|废止|效力|监管|法规|修订"
EXCHANGE = "申报|委托|挂单|下单|撮合|撤单|买卖|能否交易|交易规则"
MODEL = "模型|参数|折扣|计算"
INAPPLICABLE = "(?i)限售|锁定期|流通受限|AAP|流动性折扣|流动性折价|适用边界"
INTERRUPTIONS = ("trading_suspension", "quote_disruption")
FACETS = {
    "scope": "适用|所称|是指|包括|不含|含投资人|含投资者|本文以|执行估值核算",
    "exclusion": "不包括|不适用|不包含|不属于|除外",
    "no_quote": "(?:无|没有|不能获取|无法获取)(?:市场)?(?:报价|市价)|最近交易日.*报价",
    "quote_reliability": "(?:报价|市价).*(?:不能真实|代表性|不具代表|不能反映)",
    "inactive_market": "(?:不存在|没有|无|非)活跃市场",
    "valuation_method": "估值技术|估值方法|估值模型|AAP模型|公允价值|计算.*估值|估值.*计算|取价|看长估值|看短估值|估值全价",
    "material_impact": "潜在估值调整|(?:重大变化|重大事件).*净值|净值的影响",
    "governance_decision": "估值委员会|估值决策|估值.*管理制度|估值政策和程序",
    "governance_review": "定期复核|审阅机制|一致性|一贯性|托管人.*(?:复核|协商|审阅)",
    "governance_disclosure": "披露|临时公告",
    "governance_auditor": "会计师事务所|审计.*意见",
    "governance_responsibility": "不能免除|第一责任人|相关责任|估值工作机制",
    "exercise_state": "(?:已|未|不|放弃|选择|确认|申报|登记|撤销).{0,12}(?:回售|行权)|(?:回售|行权).{0,12}(?:前|后|日|期|状态|确认|申报)",
    "quote_options": "看长|看短|行权估值|到期估值|估值全价|估值净价|长待偿期|短待偿期",
    "quote_conditions": "(?:若|如果|情形|否则|已确认|未行使|行使回售权).*(?:看长|看短|行权估值|到期估值|估值全价|长待偿期|短待偿期)",
    "trading_procedure": "申报|委托|撤单|撮合|挂单|下单|交易时间|交易规则",
}
GOVERNANCE = ("governance_decision", "governance_review", "governance_disclosure", "governance_auditor", "governance_responsibility")
#: Intent -> roles of the sources to prefer.
ROLES = {
    "exchange_rules": ("exchange_rules", "source_document", "regulation"),
    "rule_validity": ("regulation", "specialist_guidance", "accounting_manual"),
    "specialist_valuation": ("specialist_guidance", "regulation", "accounting_manual"),
    "fund_accounting_practice": ("accounting_manual", "specialist_guidance", "regulation"),
    "special_case": ("specialist_guidance", "accounting_manual", "regulation"),
    "general_knowledge": ("source_document", "knowledge"),
}
CLAUSE = "^(?:[（(][一二三四五六七八九十百〇零两\\d]+[）)]|[一二三四五六七八九十百〇零两]+、|第[一二三四五六七八九十百〇零两\\d]+条|[a-z][）)]|情形[一二三四五六七八九十百〇零两\\d]+)"
ARTICLE = "^第[一二三四五六七八九十百〇零两\\d]+条"
SENTENCE_END = "[。；！？][”’\"）)]*$"
CONTENTS = "\\.{3,}|…{2,}|·{4,}"
BRANCH = "若|如果|情形|推荐|则|如下公式|使用.*公式"
HISTORICAL = "已废止|已失效|历史版本"
