"""Fields that hold template residue, filler, error messages or script notices instead of content."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherry.functions.timestamps import url_host
from wherry.llm.repeated_lines import line_key
from wherry.operators.skew import hot_threshold, join_by_frequency

# Words that name a field of a page, and the filler vocabulary.
FIELD_WORDS = "标题|副标题|摘要|简介|正文|内容|作者|来源|日期|时间|栏目|栏目名称|学院名称|单位名称|网站名称|站点名称|文章标题|文章摘要|文章内容|文章作者|新闻标题|发布时间|发布日期|关键词|描述|姓名|名称"
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())

_LATIN = r"[A-Za-z][\w.-]{0,39}"
_NAME = rf"(?:[A-Za-z_一-鿿][\w.-]{{0,39}})"
_OWN = rf"(?:{_LATIN}|{FIELD_WORDS})"
_PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*[#/&>^]?\s*{_NAME}(?:\s*[|:(][^{{}}]*)?\s*\}}\}}\}}?|\{{%-?\s*{_NAME}[^%{{}}]*-?%\}}|<%[=#@-]?\s*{_NAME}[^%<>]*%>|[$#]\{{\s*{_NAME}\s*\}}|\{{\$\s*{_NAME}\s*\}}|\{{[A-Za-z]+:{_NAME}[^{{}}]*/?\}}"
    rf"|(?<![A-Za-z_^\\}}]){{{_OWN}}}|\[\[\s*{_OWN}\s*\]\]|\[[%$]\s*{_NAME}\s*[%$]?\]|@@\s*{_NAME}\s*@@|(?<![\w])__{_OWN}__|(?<=[一-鿿_])__{_OWN}__|(?<![\d%])%{_OWN}(?<!\d)%|(?<![#\w])#{_OWN}#|(?<=[一-鿿])#{_OWN}#|<!--\s*{_OWN}\s*-->|^-*{_OWN}-->"
)
#: A sentence with such words talks about placeholders, fillers or errors.
_ABOUT = re.compile(r"占位写法|占位符|写法|语法|模板引擎|变量名|用法|提示语|为例|讲解|一类|区别|可用性研究|字体|调试器|placeholder|syntax|template engine", re.I)

_ERROR = re.compile(
    r"^(?:(?:http\s*(?:status|error|错误)?\s*)?[45]\d\d\s*[-–—:]?\s*(?:not found|internal server error|forbidden|bad gateway|bad request|unauthori[sz]ed|service (?:temporarily )?unavailable|gateway time-?out|error|method not allowed|gone|(?:该|此|您的)?请求未能?完成|(?:页面|服务器|网页|禁止|无法).{0,14})"
    r"|(?:error|错误)\s*[45]\d\d"
    r"|(?:抱歉|对不起|很遗憾|非常抱歉|sorry)[,，!！]?\s*(?:您|你|该|此|我们)?.{0,8}(?:页面|网页|资源|文章|栏目|内容|地址|信息|链接|服务器).{0,6}(?:不存在|被删除|已删除|找不到|未找到|无法打开|无法访问|打不开|出错|失效|下线|关闭)"
    r"|(?:您|你)(?:访问|查看|请求|浏览|打开)的.{1,6}(?:不存在|被删除|已删除|找不到|未找到|无法打开|无法访问|出错|失效)"
    r"|(?:页面|网页)(?:不存在|找不到|未找到|无法打开|出错)|无法找到该页|(?:数据库|服务器).{0,4}(?:连接|请求)?(?:失败|错误|超时|异常)|系统(?:繁忙|错误|异常|出错)"
    r"|access denied|permission denied|page not found|(?:the )?page (?:you .{0,30})?(?:cannot|could not|can't) be (?:found|displayed)|(?:the )?(?:requested )?(?:page|url|resource|article).{0,40}(?:not found|does not exist|no longer exists|was not found|has been removed|could not be found|is (?:unavailable|missing))|sorry,? .{0,50}(?:not found|removed|exist|unavailable|wrong|deleted)|oops|something went wrong|an? (?:unexpected |internal )?error (?:has )?occurred|(?:fatal error|warning|notice|parse error)\s*:|uncaught |traceback|exception in|stack trace|service unavailable|internal server error|bad gateway|403 forbidden|404|502 bad|connection (?:refused|timed out|failed)|(?:database|mysql|sql) .{0,20}(?:error|failed)|error establishing|too many requests)",
    re.I,
)
_SCRIPT = re.compile(
    r"(?:请|必须|需要|需|须|您要|得)\s*(?:先|您|首先)?\s*(?:启用|打开|开启|允许|激活|使用|支持|运行)\s*(?:您?的?浏览器的?)?\s*(?:javascript|java script|js|脚本|浏览器脚本)"
    r"|(?:依赖|需要|要求|必须)\s*(?:js|javascript)?\s*脚本\s*(?:支持|运行|才能)|(?:浏览器|您)?.{0,6}(?:已)?(?:禁用|关闭|不支持|拦截)(?:了)?\s*(?:js|javascript|脚本)|脚本(?:被)?(?:禁用|拦截|关闭)|未检测到\s*(?:js|javascript|脚本)"
    r"|(?:need|have|required|must|please) (?:to )?(?:enable|activate|turn on|allow|switch on)\s*(?:your )?(?:java ?script|js|scripts?|scripting)|(?:enable|activate|turn on|allow|switch on) (?:java ?script|js|scripts?|scripting)(?: support)?(?: in your browser)?|without (?:java ?script|js|scripts|scripting)|requires? (?:java ?script|js|scripts|scripting)|(?:java ?script|scripting|scripts?) (?:is|are|must be|has been|have been) (?:disabled|required|turned off|switched off|blocked|enabled)",
    re.I,
)
_FILLER = re.compile(
    r"^(?:(?:(?:示例|测试|占位|默认|演示|样例)(?:文字|文本|内容|数据|标题|页面|文章)?){2,}\d*|(?:示例|测试|占位|默认|演示|样例)(?:文字|文本|内容|数据|标题|页面|文章)\d*|测试\d*|(?:这|此|以下|本段)(?:是|里是|为).{0,4}(?:示例|测试|占位|默认|演示|样例)(?:文字|文本|内容|数据|标题|段落)(?:[,，].{0,24})?"
    r"|(?:请|您可以)?(?:在)?(?:此|这里|此处|这儿|下方)(?:处)?\s*(?:输入|填写|编辑|添加|键入|录入|插入).{0,12}(?:\([^()]*\))?|(?:请)(?:输入|填写|编辑|添加).{0,10}(?:标题|摘要|简介|正文|内容)"
    r"|(?:内容|摘要|简介|标题|正文|信息)?(?:待定|待补充|待更新|待完善|待添加|建设中|更新中|敬请期待|暂无(?:内容|摘要|简介|标题)?|暂缺|略)(?:[,，].{0,10})?|[(（]略[)）](?:待更新|待补充)?|暂无(?:内容|摘要|简介|数据|介绍|正文)(?:[,，].{0,10})?"
    r"|(?:tbd|tba|todo|fixme|待办)\b[:：]?.{0,30}|to be (?:determined|announced|continued|added|written)|coming soon|n/?a|untitled(?: document| page)?|no title|无标题(?:文档)?|未命名|新建(?:文档|页面|文章)|(?:sample|dummy|placeholder|example|filler|default) (?:text|content|page|title|post|abstract).{0,60}|(?:your|insert|enter|type|write|add|put|edit|place) (?:your |the |an? )?(?:title|text|content|abstract|summary|description|heading|headline)(?: (?:goes )?here)?|(?:title|text|content|abstract|summary|description) (?:goes )?here|this is (?:a |an |some )?(?:sample|dummy|placeholder|example|test|default|filler).{0,80}|hello world|xxx+|(?:test|testing)(?: test| testing)*\s*\d*)$",
    re.I,
)
_MASH = re.compile(r"^(?:(?:asdf|qwer|hjkl|zxcv|jkl|fdsa|sdfg|dfgh|wert|uiop|([a-z])\1{2,})[a-z]{0,4}\s*)+$")
#: What may follow or surround an error message and is no content itself.
_NEUTRAL = re.compile(
    r"^(?:错误(?:代码|编号|码|信息)?\s*[:：]?\s*\w{0,12}|(?:request|error|trace|incident|reference)\s*(?:id|code|no\.?|number)?\s*[:：#]?\s*[\w-]{1,40}|请?(?:返回|点击|联系|检查|稍后|刷新|重试|尝试|通过).{0,24}|(?:please )?(?:try again|go back|return to|contact|check|reload|refresh|click).{0,60}|您可以.{0,30}|(?:nginx|apache|tomcat|iis|openresty).{0,20}|(?:in|on|at) line \d+|in /.{0,80}|[\W\d_]*|后?(?:刷新|再访问|继续|浏览|查看).{0,12}|(?:才能|以|以便).{0,14}|发布前请删除|请替换.{0,12}|用于.{0,10}(?:版式|排版|测试|演示))$",
    re.I,
)


# Of what messages speak, what they say of it, and the words around.
_THINGS = r"pages?|sites?|websites?|apps?|applications?|resources?|urls?|address(?:es)?|links?|files?|documents?|articles?|sessions?|login|tokens?|requests?|connections?|servers?|services?|databases?|queries|gateways?|hosts?|content|页面|网页|网站|站点|应用|程序|资源|地址|链接|文件|文档|文章|栏目|内容|信息|会话|登录状态|令牌|请求|连接|服务器|服务|数据库|网关|主机|系统|接口|权限|账号"
_STATES = r"not found|(?:could|can) ?(?:not|n't|’t) be (?:located|found|reached|loaded|opened|displayed|processed|completed|established)|(?:can|could) ?(?:not|n't|’t) (?:find|reach|load|open|connect|display|process|complete|locate)|unable to (?:find|reach|load|open|connect|display|process|complete|locate)|does ?(?:not|n't) exist|no longer (?:exists?|available)|(?:has |have )?(?:expired|failed|timed out|been (?:removed|moved|deleted|blocked|suspended|reset|closed|refused|denied))|unavailable|missing|denied|forbidden|unauthori[sz]ed|refused|overloaded|errors?|exceptions?|went wrong|已?(?:经)?(?:过期|失效|超时|失败|中断|断开|拒绝|删除|移除|下线|关闭|丢失|损坏|不存在|不可用|找不到|未找到)|不存在|不可用|未能?(?:找到|完成|响应|加载)|无法(?:找到|打开|访问|连接|显示|加载|处理|完成|响应)|找不到|打不开|连接不上|没有(?:权限|响应)|无权(?:访问|限)?|错误|异常|出错|故障|繁忙"
_AROUND = r"the|this|that|an?|you|your|we|our|it|its|is|was|are|were|has|have|been|be|to|on|at|in|of|for|from|by|or|and|please|sorry|oops|again|later|try|trying|log|sign|in(?:to)?|back|go|return|home|contact|administrator|admin|webmaster|check|refresh|reload|requested|request(?:ing)?|looking|access(?:ed)?|visit(?:ed)?|code|id|http|status|internal|unexpected|unknown|temporarily|currently|an?|抱歉|对不起|很遗憾|非常|您|你|我们|该|此|本|当前|所|的|了|已|被|请|重新|登录|重试|再试|刷新|稍后|返回|首页|联系|管理员|客服|检查|网络|访问|请求|查看|浏览|打开|或|和|与|并|后|可能|由于|因|发生|出现|内部|未知|临时|暂时|代码|编号|状态"
_SCRIPTS = r"java ?scripts?|js|scripts?|scripting|client.?side|脚本"
_NEEDS = r"enabled?|enabling|activated?|allow(?:ed)?|turn(?:ed)? (?:on|off)|switch(?:ed)? (?:on|off)|requires?|required|needs?|must|without|disabled|blocked|supports?|supported|(?:does|do|can|will) ?(?:not|n't|’t) (?:run|work|start|load|function)|cannot (?:run|work|start|load|function)|启用|打开|开启|允许|激活|需要|必须|须|才能|禁用|关闭|拦截|不支持|支持|未检测到|检测到|依赖|要求"
_USES = r"browsers?|浏览器|properly|correctly|run|runs|work|works|start|starts|use|using|view|continue|运行|使用|正常|继续|功能|设置|中|后|以"


def _says_only(low: str, things: str, states: str, around: str, most: float = 0.15) -> bool:
    """Whether a lower-case message holds a thing and a state, and little else than words that go with them."""
    if len(low) > 120 or not (found := re.search(states, low)):
        return False
    rest = low[: found.start()] + " " + low[found.end() :]
    if not re.search(rf"(?<![a-z])(?:{things})(?![a-z])", rest):
        return False
    rest = re.sub(rf"(?<![a-z])(?:{states}|{things}|{around})(?![a-z])", " ", low)
    return len(re.findall(r"[^\W\d_]", rest)) <= most * len(re.findall(r"[^\W\d_]", low))


def plain(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def segments(text: str) -> list[str]:
    """Normalised lines and sentences of a field."""
    parts = re.split(r"\n|\s{2,}|　|(?<=[。！？!?；;])|(?<=[a-z\"\])]\.)\s", text)
    return [p for x in parts for p in [plain(x)] if p]


def segment_column(text: Column) -> Column:
    """The keys of a field's segments, for counting."""
    parts = F.split(F.regexp_replace(text, r"([。！？!?；;])", "$1\n"), r"\n|\s{2,}|　")
    return F.filter(F.transform(parts, line_key), lambda k: k != "")


def _segment_kind(s: str) -> str:
    """``filler``, ``error``, ``script``, ``neutral`` or ``content`` of a segment."""
    bare = s.strip(" .。!！?？,，;；…~·-—:：")
    low = bare.lower()
    if not bare:
        return "neutral"
    if _ABOUT.search(bare):
        return "content"
    if _FILLER.match(low) or _MASH.match(low) or _lorem(low):
        return "filler"
    if _ERROR.match(low):
        return "error"
    scripts = "script" in low or "js" in low or "脚本" in low  # part of all that follows
    if scripts and (_SCRIPT.search(low) or _says_only(low, _SCRIPTS, _NEEDS, f"{_USES}|{_THINGS}|{_AROUND}")):
        return "script"
    if _says_only(low, _THINGS, _STATES, _AROUND):
        return "error"
    return "neutral" if _NEUTRAL.match(low) else "content"


def _lorem(low: str) -> bool:
    words = re.findall(r"[a-z]+", low)
    return len(words) >= 2 and not re.search(r"[一-鿿]", low) and sum(w in LOREM for w in words) >= 0.8 * len(words)


def evidence(text: str, recurrent: frozenset[str] = frozenset()) -> str | None:
    """What kind of residue a field is: ``placeholder``, ``filler``, ``error``, ``script``, or None for content.

    ``recurrent`` holds the line keys that the host repeats. They are subtracted
    first, but for lines that are evidence themselves, so that an error message
    that a host shows everywhere is still one.
    """
    kinds: list[str] = []
    for s in segments(text):
        if _PLACEHOLDER.search(s) and not _ABOUT.search(s):
            return "placeholder"
        kind = _segment_kind(s)
        if kind == "content" and key_of(s) in recurrent:
            continue
        kinds.append(kind)
    found = [k for k in kinds if k in ("filler", "error", "script")]
    if not found or "content" in kinds:
        whole = _segment_kind(plain(text))
        return whole if whole in ("filler", "error", "script") and "content" not in kinds else None
    return found[0]


def key_of(segment: str) -> str:
    """:func:`line_key` of a segment, in Python."""
    return re.sub(r"[0-9]+", "0", re.sub(r"\s+", "", segment.lower()))


def recurrent_lines(records: DataFrame, least_records: int = 5, least_share: float = 0.05) -> DataFrame:
    """``host, host_records, keys``: the line keys found in at least ``least_records`` records and ``least_share`` of the records of their host.

    Lines of title and abstract are counted per host and hash of the key with
    partial sums; a host can have no more keys than its lines per record divided
    by ``least_share``, so the array is bounded.
    """
    sizes = records.groupBy("host").agg(F.count("*").alias("host_records"))
    fields = F.concat(F.coalesce(segment_column(F.col("abstract")), F.array().cast("array<string>")), F.coalesce(segment_column(F.col("title")), F.array().cast("array<string>")))
    lines = records.select("host", F.explode(F.array_distinct(fields)).alias("key")).select("host", F.xxhash64("key").alias("h"), "key")
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    often = counts.where(F.col("n") >= least_records).join(sizes, "host").where(F.col("n") >= F.col("host_records") * least_share)
    keys = often.groupBy("host").agg(F.collect_set("key").alias("keys"))
    return sizes.join(keys, "host", "left")


def residue(records: DataFrame) -> DataFrame:
    """``record_no, field, kind`` of the fields that hold residue instead of content.

    ``records``: ``record_no, url, title, abstract``. A url as title, empty and
    null fields are none. Lines that a host repeats are subtracted before a field
    is judged (see :func:`evidence`), every field; host lists of hosts with many
    records are broadcast, the others meet their records in one shuffle. Records without host are judged
    without subtraction; repeated rows give repeated results.
    """
    rows = records.select("record_no", "url", "title", "abstract", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"))
    hosts = recurrent_lines(rows)
    field = F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("abstract").alias("field"), F.col("abstract").alias("text")))).alias("f")
    fields = rows.select("record_no", "host", "url", field).select("record_no", "host", "f.field", "f.text", "url")
    suspects = fields.where(F.col("text").isNotNull() & (F.trim("text") != "") & ~(F.col("url").eqNullSafe(F.col("text")))).drop("url")
    joined = join_by_frequency(suspects, hosts, "host", F.col("host_records"), hot_threshold(records.count()))

    @F.pandas_udf("string")
    def judge(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([evidence(t, frozenset(k) if k is not None else frozenset()) for t, k in zip(texts, keys, strict=True)], dtype=object)

    judged = joined.select("record_no", "field", judge("text", "keys").alias("kind"))
    return judged.where(F.col("kind").isNotNull())
