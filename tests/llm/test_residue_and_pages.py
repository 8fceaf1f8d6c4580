import pytest

from wherry.llm import main_content, markup, residue

CASES = [
    ("{{ page_title }}", "placeholder"), ("关于<!--学院名称-->的通知", "placeholder"), ("法学院{% 标题 %}", "placeholder"), ("__author___{$abstract}", "placeholder"), ("#{摘要}", "placeholder"), ("统计学院{学院名称}", "placeholder"), ("关于%文章标题%的通知", "placeholder"), ("[[news_title]] - 教务处", "placeholder"), ("体育部于{{abstract}}举办{cms:abstract/}活动，欢迎参加。", "placeholder"), ("--文章标题--> | @@pageTitle@@", "placeholder"),
    ("404 Not Found", "error"), ("500 Internal Server Error. Please try again later.", "error"), ("抱歉，您访问的页面已被删除。错误代码：0x3", "error"), ("数据库连接失败，请联系管理员", "error"), ("Access denied: your address is blocked", "error"), ("HTTP Status 500 – 该请求未能完成", "error"),
    ("您需要打开JavaScript后刷新本站.", "script"), ("This app doesn't work properly without JavaScript enabled", "script"), ("当前页面需要脚本运行，未检测到 JS 支持.", "script"), ("You need to allow scripting in your browser。", "script"),
    ("Ipsum tempor ut lorem lorem tempor adipiscing.", "filler"), ("示例文字示例文字示例文字", "filler"), ("测试测试测试3", "filler"), ("此处输入内容(200字以内)", "filler"), ("TBD", "filler"), ("TODO: 补充摘要", "filler"), ("qwer hjkl xxxx", "filler"), ("这是一段默认文字，请替换为正式内容。", "filler"), ("内容待定", "filler"), ("（略）待更新", "filler"), ("暂无摘要，稍后补充", "filler"),
    ("模板引擎语法入门：从 {{ }} 说起", None), ("讲座介绍 {name} 与 {{ name }} 两种占位写法的区别，由华研究员主讲。", None), ("网页错误提示的可用性研究——易院长谈认知负荷", None), ("JavaScript 程序设计培训班开课通知", None), ("课程讲解如何启用浏览器的 JavaScript 调试器，主讲容副教授，共9讲。", None), ("Lorem ipsum 字体展在静湖报告厅开幕", None), ("排版课以 lorem ipsum 为例，分析了西文断行的3条规则。", None), ("Error analysis in quantum sensing", None), ("500 强企业宣讲会走进体育部", None), ("[物理学院] 博物馆策展工作坊", None), ("经济学院软件测试讲座报名", None), ("关于机器翻译平台停机维护的通知", None), ("席院长比较了“页面不存在”一类提示语的3种写法，并总结其对用户的影响。", None), ("准确率提高了10%，成本下降了20%。", None), (" ", None), ("正文" * 50_000, None),
]


@pytest.mark.parametrize(("text", "kind"), CASES)
def test_evidence(text, kind):
    assert residue.evidence(text) == kind


def test_recurrent_lines_are_subtracted():
    assert residue.evidence("首页 新闻  抱歉，您访问的页面不存在") is None
    assert residue.evidence("首页 新闻  抱歉，您访问的页面不存在", frozenset([residue.key_of("首页 新闻")])) == "error"


def test_residue_table(spark):
    rows = [(k, "http://a.example/x", "好新闻", f"首页 要闻  正文第{k}段。") for k in range(8)]
    rows += [(20, "http://a.example/y", "404 Not Found", "首页 要闻  抱歉，您访问的页面不存在"), (21, "http://a.example/z", "http://a.example/z", ""), (22, None, None, None), (20, "http://a.example/y", "404 Not Found", None)]
    got = residue.residue(spark.createDataFrame(rows, "record_no long, url string, title string, abstract string").selectExpr("*", "1 as host"))
    assert sorted((r["record_no"], r["field"], r["kind"]) for r in got.collect()) == [(20, "abstract", "error"), (20, "title", "error"), (20, "title", "error")]
    assert residue.residue(spark.createDataFrame([], "record_no long, url string, title string, abstract string")).collect() == []


PAGE = """首页　
师资队伍
您的位置: 首页 >> 学院新闻 >> 明志楼算法公平研讨会侧记（1月10日）
明志楼算法公平研讨会侧记（1月10日）
发布日期：2021-01-26  来源：统计学院  作者：容副教授
与会代表生动总结了平台搭建和数据共享两项议题。蓝同学说，参加水资源定价座谈会让自己对课程改革有了新的认识！

骆研究员提醒，版权所有者应在8日内登记，未经授权禁止转载的作品不得用于统计推断工作坊。
【打印本页】【关闭窗口】
该课题编号为YP2018-90725，负责人为信息学院席副教授。
附件：量子测量开放日报名表7.docx
供稿：图书馆通讯员 2015-02-05
上一篇：数学学院赴智能学院调研质量保障
下一条：没有了
相关新闻
[08/10] 关于开展2019年流域水质论坛的通知
沈主任谈认知负荷与平台搭建
阅读次数：41609
版权所有 © 2017 云浦大学图书馆  未经授权禁止转载"""


def test_main_content():
    assert main_content.foreign_lines(PAGE) == [1, 2, 3, 9, 13, 14, 15, 16, 17, 18, 19]
    assert main_content.main_content(PAGE).split("\n")[0].startswith("明志楼")
    assert main_content.foreign_lines("") == []
    assert main_content.foreign_lines("# 标题\n\n正文一段。\n\n```\nmake build\n```") == []


def test_best_span_is_greatest():
    assert main_content.best_span([-1, 2, -1, 3, -5, 4]) == (1, 4)
    assert main_content.best_span([-1, -2]) == (0, 0)


def test_abstract_pieces():
    good = ["骆研究员提醒，版权所有者应在8日内登记。", "新版首页增加了古籍修复栏目，Cookie 的保存期限由189天缩短为12天。", "A clinic on privacy and copyright drew 85 readers to Mingzhi Hall.", ""]
    bad = ["首页  党建工作  学院新闻 相关新闻 关于开展2024年乡村治理开放日的通知", "正文。 上一篇：学生会举办志愿服务论坛 下一篇：艺术学院举办展览", "Doors open at 9:30; © London Desk, Yunpu University.", "我们使用 cookies 统计访问量 [接受] [拒绝] 正文。"]
    assert main_content.foreign_abstract_flags(good + bad) == [False] * 4 + [True] * 4


def test_markup_kinds():
    assert markup.convert("<h1>A <b>b</b>&amp;c</h1><ul><li>x<li>y</ul><pre>a &lt; b</pre><p>\\(z^2\\)</p><nav><h2>no</h2></nav>")[1] == [("heading", "A b&c"), ("list_item", "x"), ("list_item", "y"), ("code_block", "a < b"), ("formula", "z^2")]
    assert markup.convert("# T\n\nS **b**\n---\n\n- one [l](u)\n- t*w*o\n\n```py\nx = 1\n```\n\n$$\na+b\n$$ \n\nc $d$ e")[1] == [("heading", "T"), ("heading", "S b"), ("list_item", "one l"), ("list_item", "two"), ("code_block", "x = 1"), ("formula", "a+b"), ("formula", "d")]
    assert markup.convert("== H '''x''' ==\n* [[A|b]]\n# c<ref>r</ref>\n<math>e</math>\n<syntaxhighlight lang=\"text\">\nf\n</syntaxhighlight>")[1] == [("code_block", "f"), ("formula", "e"), ("heading", "H x"), ("list_item", "b"), ("list_item", "c")]
    assert markup.convert("\\section*{A\\emph{b}}\\label{s}\n\\begin{itemize}\\item x\\textbf{y}\\item z~\\cite{q}\\end{itemize}\\begin{verbatim}\nc\n\\end{verbatim}\\[ d \\] e\\%")[1] == [("code_block", "c"), ("formula", "d"), ("heading", "Ab"), ("list_item", "xy"), ("list_item", "z")]
    for plain in ("C# 与 F# 选修课各3学分，文件名为 my_3_file_name.txt。", "3 * 7 的展板放在#7教学楼，门票 $13，团体票 $37。", "当 p < 8 且 q > 7 时，模型不收敛。", "", "评分区间为[0, 0)，等级=A*或B+。"):
        assert markup.convert(plain) == (plain, [])


def test_elements_table(spark):
    rows = spark.createDataFrame([(1, "# a\n# a"), (2, None), (3, "")], "file_id long, body string")
    assert [(r["row_id"], r["kind"], r["item"]) for r in markup.elements_of(rows, "file_id", "body").collect()] == [(1, "heading", "a")]
    assert markup.convert_all(rows, "file_id", "body").count() == 2
