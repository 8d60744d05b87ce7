"""Names and wordings that documents state their origin by."""

# Name of an issuer -> the names it goes by. In a title the earliest counts, of those the longest.
ISSUERS = {
    "全国人大常委会": ("全国人民代表大会常务委员会", "全国人大常委会"),
    "国务院": ("中华人民共和国国务院", "国务院"),
    "中国证监会": ("中国证券监督管理委员会", "中国证监会", "证监会"),
    "财政部": ("中华人民共和国财政部", "财政部"),
    "国家税务总局": ("国家税务总局", "税务总局"),
    "中国人民银行": ("中国人民银行",),
    "中国证券投资基金业协会": ("中国证券投资基金业协会", "中基协", "基金业协会"),
    "中国证券业协会": ("中国证券业协会", "中证协"),
    "中国银行间市场交易商协会": ("中国银行间市场交易商协会", "交易商协会"),
    "上海证券交易所": ("上海证券交易所", "上交所"),
    "深圳证券交易所": ("深圳证券交易所", "深交所"),
    "北京证券交易所": ("北京证券交易所", "北交所"),
    "全国中小企业股份转让系统": ("全国中小企业股份转让系统",),
    "中国金融期货交易所": ("中国金融期货交易所", "中金所"),
    "上海国际能源交易中心": ("上海国际能源交易中心",),
    "上海期货交易所": ("上海期货交易所",),
    "郑州商品交易所": ("郑州商品交易所",),
    "大连商品交易所": ("大连商品交易所",),
    "广州期货交易所": ("广州期货交易所",),
    "上海黄金交易所": ("上海黄金交易所",),
    "中国证券登记结算": ("中国证券登记结算", "中国结算"),
    "银行间市场清算所（上海清算所）": ("银行间市场清算所", "上海清算所"),
    "中债资信评估": ("中债资信评估有限责任公司", "中债资信"),
    "中央国债登记结算（中债）": ("中央国债登记结算", "中债"),
    "中国外汇交易中心": ("中国外汇交易中心", "外汇交易中心", "交易中心"),
    "中证指数": ("中证指数有限公司", "中证"),
    "深圳证券信息（国证）": ("深圳证券信息有限公司", "国证债券"),
}
#: How an issuer's document numbers begin, tried in this order.
NUMBER_ISSUERS = (
    ("中国证券监督管理委员会|证监", "中国证监会"), ("中基协|中国基金业协会", "中国证券投资基金业协会"), ("中证协", "中国证券业协会"), ("中国人民银行|人民银行|银发", "中国人民银行"), ("财会|财税|财金|财政部", "财政部"),
    ("国家税务总局|税务总局|国税", "国家税务总局"), ("国务院|国发|国办发", "国务院"), ("上证", "上海证券交易所"), ("深证", "深圳证券交易所"), ("北证", "北京证券交易所"), ("股转", "全国中小企业股份转让系统"), ("中金所", "中国金融期货交易所"),
    ("上期", "上海期货交易所"), ("郑商", "郑州商品交易所"), ("大商", "大连商品交易所"), ("广期所", "广州期货交易所"), ("交易商协会|中市协", "中国银行间市场交易商协会"), ("中国结算", "中国证券登记结算"),
)
NUMBER = (
    "(?:[一-龥A-Za-z]{1,16}\\s*[〔\\[【［]\\s*(?:19|20)\\d{2}\\s*[〕\\]】］]\\s*第?\\s*\\d{1,4}\\s*号"
    "|(?:中国证券监督管理委员会|证监会|国务院|中华人民共和国主席)令\\s*第\\s*\\d{1,4}\\s*号"
    "|(?:财政部\\s*(?:国家)?税务总局|国家税务总局|税务总局|财政部)公告\\s*(?:19|20)\\d{2}\\s*年\\s*第\\s*\\d{1,4}\\s*号)"
)
DATE = "(\\d{4})\\s*年\\s*(\\d{1,2})\\s*月\\s*(\\d{1,2})\\s*日"
CHINESE_DATE = "[○〇零一二三四五六七八九]{4}\\s*年\\s*[一二三四五六七八九十]{1,2}\\s*月\\s*[一二三四五六七八九十]{1,3}\\s*日"
ANNEX = "[—\\-－]\\s*附件|附件[\\d一二三四五六七八九十]*\\s*[：:]"
RECORD = "(?<!》)[（(][^（）()《》]{0,140}?(?:公布|发布|印发|颁布)[^（）()《》]{0,60}[）)]"
PUBLISHED = "公布|发布|印发|颁布"
#: Cells of metadata tables.
CELLS = {"issuer": ("【发布部门】\\s*([^\\t\\n【】]*)", "(?<![一-龥])发文单位\\t([^\\t\\n]*)"), "number": ("【发布文号】\\s*([^\\t\\n【】]*)", "(?<![一-龥])文号\\t([^\\t\\n]*)")}
CHROME = "版权|Copyright|©|ICP|公网安备|网站|主办|承办|技术支持|联系我们|地址|电话|邮箱|传真|邮编|微信|English|首页|登录"
SIGNATURE_WORDS = "公告|文件|印发|发布|发文|[、，,\\s　]"
CITED = "根据|依据|按照|参照|废止|关于"

# How texts say that something was done, and what makes that a requirement, a condition or a denial.
DONE = (
    "(?:已经|业已|确已|现已|已)(?:(?:成功|全部|实际|正式|确实)|(?:为|替|帮)[^，,。；;\\n]{1,16}?)?(?:完成|取得|获得|获批|获|批准|确认|执行|付款|支付|过账|入账|到账|发布|审批|审核|复核|核对|核验|授权|通过|记录)"
    "|(?:付款|支付|过账|入账|审批|审核|复核|发布)(?:已经|已)?(?:完成|成功|通过)|(?:完成|执行|支付|付款|过账|批准|确认)了|(?:并非|不是|不能说)(?:没有|未曾|尚未|未|没)(?:完成|执行|支付|付款|过账|批准|确认)"
)
CLAUSE = "[，,。；;\\n！？!?]|但是|然而|不过|(?<!不)但(?!书)|却|随后|然后|接着|因此|所以|那么|则|而且|并且|以及|或者|且|或(?!许)|并(?=已|实际|确实|我|本助手)"
SENTENCE = "[。；;\\n！？!?]"
CONJUNCTIONS = ("且", "并且", "以及", "或", "或者", "并")
DENIAL = (
    "(?:不(?:表示|代表|意味着|等同于|等于|构成|属于|认为)|(?:不能|无法|不可|不得|不应|不足以)(?:够)?(?:直接)?(?:被)?(?:作为|当作|当成|算作|视为|认定为?|证明|确认|证实|说明|表明)"
    "|(?:没有|尚未|并未|未曾|未)(?:表示|声称|宣称|确认|证明|证实)|并非|不是)"
)
UNDENIED = "不|未|没有|实际|确实"
DOUBLE_DENIAL = "(?:不是|并非|没有|不能说|不能认为)[^，,。；;\\n]{0,12}(?:不能|不|未|没有|无法|并非)|(?:不能|无法|不)否认|(?:不能|不得|不可)不(?:承认|认为|认定|表示)|无不|难道[^，,。；;\\n]{0,12}(?:不是|没有|未|不)"
REQUIREMENT = (
    "(?:需要|必须|应当|务必|建议|计划|准备|等待|需|须|应|请|拟|待)(?:先|再|进一步|逐项)?(?:核对|确认|检查|复核|核验|验证|确保|查明|证明|取得|提供)"
    "|(?:^|[:：])\\s*(?:先|再)?(?:核对|检查|复核|核验|验证|确认)(?!结果)|(?:必须|须|需|要求)(?:先|事先)?$"
)
QUESTION = "是否|有没有|有无|(?:能否|可否)(?:确认|证明|证实)?"
CONDITION = "(?:^|[:：(（])\\s*(?:如果|假如|假设|倘若|一旦|只要|除非|仅当|若|当(?!前|时|下|地|然)|如(?=已))|(?:前提|条件)(?:是|为|包括|要求)?[:：]?$"
CONSEQUENCE = "(?:前|后|时)(?:方可|才可|才能|再|应|需|须)"
REPORT = "事实上|实际上|(?:实际|确实)(?=已经|已|完成|付款|支付|过账|批准)|确已|现已|现状[:：]|结果表明|结果是|经核实|经确认|不仅|不但|难道"
SPEAKER = "本助手|本模型|本系统|我(?:们|方)?"
