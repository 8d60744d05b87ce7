"""Wordings of clauses that replace one rule by another."""

# How rules are issued, repealed and replaced, when that holds, and what makes it uncertain.
BOOK = "《((?:[^《》]|《[^《》]*》)+)》"
REPEAL = "(?:同时|相应|即行|予以)?(?:废止|停止(?:执行|适用)|不再执行)"
ISSUES = (f"现(?:予|将)?(?:公布|发布|印发)\\s*{BOOK}", f"现[^。；\\n《]{{0,24}}{BOOK}[^。；\\n]{{0,16}}(?:公布|发布|印发)", f"(?:新修订的|修订后的|修订的)\\s*{BOOK}[^。；]{{0,120}}现予以发布")
LISTS = "废止|清理|失效目录|目录|清单"
PAIR = f"{BOOK}[^。；\\n《]{{0,100}}?(?:替代|取代)\\s*{BOOK}"
DATE = "(\\d{4})[年./-](\\d{1,2})[月./-](\\d{1,2})日?"
START = f"(?:自|于)\\s*{DATE}\\s*起?[^。；\\n]{{0,12}}(?:施行|实施|执行|生效)"
ON_PUBLICATION = "自(?:公布|发布|印发)之日起(?:施行|实施|执行|生效)"
OWN_START = "本(?:规则|办法|规定|指引|通知|标准)[^。；\\n]{0,24}自"
UNCERTAIN = "尚未|并未|不会|不能|不应|不得|不予|没有|未予|拟予|拟将|建议|可能|征求意见|草案|不再废止|(?:不|未|未被)(?:予以|被|直接|同时)?(?:废止|替代|停止)"
PART = "部分|第[^，。；《]{1,12}[条款项]"
#: Issuers that titles begin with, and their short forms; other issuers stay as they are.
ALIASES = {"中国证券监督管理委员会": "中国证监会", "中国证券投资基金业协会": "中基协", "中国银行保险监督管理委员会": "中国银保监会", "中华人民共和国财政部": "财政部"}
