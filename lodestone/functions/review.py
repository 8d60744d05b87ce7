"""Patterns and line parsers of source and answer reviews."""

from __future__ import annotations

import re
from collections.abc import Iterator

from lodestone.sources.text import evidence_ids

# How review facts are worded in sources and answers.
DAY = "第([一二三四五六七八九十百零〇两0-9]{1,5})([一-鿿]{0,6}日)"
MODE = "(?:以)?([一-鿿]{1,12}模式)"
MODE_LEADS = ("以", "按照", "按", "采用")
JOURNAL = r"^\s*(借|贷)\s*[:：]\s*\S"
ALTERNATIVE = "或|反向|另一个|另一种|分别如下|示例[一二三四1234]"
NEGATIVE = "不应|不在|不是|不能|不完成|不进行|不释放|尚未|未完成|无需|错误|错写|误写|误称|应更正"
ARTICLE = r"^\s*第[一二三四五六七八九十百零〇0-9]+[条章节]"
SCOPE = "适用(?:于|范围)|仅(?:限于|适用|针对)|不适用|本(?:标准|规则|指引).*使用|对于"
EXPANSION = "(?:即|因此|意味着|由此|可见)[^。\\n]{0,100}(?:所有|均|同样|一律|等同|已包含)|所有.*适用|一律适用|同样适用"
BASIS = "估值(全价|净价)"
ACTION = "(释放|退还|支付|划付|划转|扣除|提交|交付|收取)([^，。；;\\n]{2,30})"
EVENT = "当日为([^，。；;\\n]{2,18})"
ENTRY_BOUNDARY = r"[。；：:]$|^\s*(?:[①②③④⑤⑥⑦⑧⑨]|[（(][一二三四五六七八九十0-9]+[）)]|第[一二三四五六七八九十0-9]+[章节条])"
DAY_HEADING_LEAD = r"^[\s#（()）一二三四五六七八九十0-9、.\-]*"


def answer_lines(text: str) -> Iterator[tuple[int, int, int, bool, bool, bool, list[int], str]]:
    """(line, start, end, fence mark, inside a fence, hidden, evidence numbers, text) of an answer's lines.

    A fence is closed by marks of the character that opened it. Marks, fenced and quoted lines are hidden: they cite nothing.
    """
    fence, at = "", 0
    for n, line in enumerate(text.split("\n")):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if mark:
            fence = "" if fence == mark[1][0] else fence or mark[1][0]
        hidden = bool(mark or fence or line.lstrip().startswith(">"))
        yield n, at, at + len(line.rstrip()), bool(mark), bool(fence and not mark), hidden, [] if hidden else evidence_ids(line), line
        at += len(line) + 1
