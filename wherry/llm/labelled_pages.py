"""Lines labelled one by one, from which the weights of the main-content operator are learned.

All lines are made up for this purpose and taken from no table. Each begins with
its label: ``-`` not part of an article, ``+`` part of one, ``=`` title-like (an
article's own title or an entry in a list of others; its words say nothing, its
place decides). Numbers are read as 0.
"""

LINES = """\
- 首页
- 网站首页
- 学校概况
- 机构设置
- 院系设置
- 师资队伍
- 人才培养
- 本科教学
- 研究生教育
- 科学研究
- 招生就业
- 合作交流
- 国际交流
- 党建工作
- 党群工作
- 学生工作
- 校友之窗
- 校园文化
- 信息公开
- 新闻中心
- 学院新闻
- 通知公告
- 学术讲座
- 下载中心
- 联系我们
- 旧版入口
- 首页 学校概况 院系设置 科学研究 招生就业 合作交流
- 首页 | 新闻 | 公告 | 下载 | 联系我们
- 首页 · 师资队伍 · 人才培养 · 通知公告 · 校友之窗
- 首页 / 科研动态 / 学生工作 / 党建工作
- 登录 | 注册 | English
- 登录 注册 English 旧版
- 用户登录
- 请先登录后再发表评论
- 中文 | English
- 设为首页 加入收藏
- 设为首页 | 加入收藏 | 联系站长
- 跳到主要内容
- 跳转到正文
- 返回顶部
- 当前位置：首页 > 新闻中心 > 学院新闻 > 正文
- 您的位置：首页 >> 通知公告 >> 详情
- 您现在的位置: 首页 » 科学研究 » 学术动态
- 所在位置：首页 › 招生就业 › 就业信息
- 当前位置: 首页 → 党建工作 → 正文
- 首页 > 人才培养 > 本科教学
- 首页 >> 校园文化 >> 正文
- 本网站使用 Cookie 改善您的浏览体验，继续访问即表示您同意。 [接受] [拒绝]
- 我们使用cookies统计访问情况 接受 拒绝
- 本站会记录Cookie信息以便统计访问量，【同意】【查看隐私政策】
- 使用本网站即表示同意我们的 Cookie 政策与隐私声明。
- 接受全部 仅必要 设置
- 分享到：微信 微博 QQ空间
- 分享到 微博 豆瓣 人人网
- 分享：
- 分享至朋友圈
- 【打印本页】【关闭窗口】
- 【打印】【关闭】【收藏】
- 打印本文 关闭窗口
- 【字体：大 中 小】
- 扫一扫关注学院官方微信公众号
- 扫码关注我们的公众号，获取更多资讯
- 关注官方微博
- 请长按二维码关注
- 点赞 收藏 转发
- 上一篇：关于举行期末考试的安排
- 下一篇：我校召开年度工作会议
- 上一条：没有了
- 下一条：没有了
- 上一页 下一页
- 上一篇：学院举办迎新晚会 下一篇：学院召开教师座谈
- 【上一条】某某学院召开动员会
- 【下一条】某某中心发布招标公告
- 相关新闻
- 相关阅读
- 相关文章
- 热点新闻
- 热门文章
- 推荐阅读
- 最新公告
- 最新通知
- 近期活动
- 更多内容
- 延伸阅读
- 猜你喜欢
- 点击排行
- 更多>>
- 更多 +
- [查看更多]
- 我校代表队近日在比赛中取得优异成绩，受到……[查看全文]
- 为进一步做好后勤保障工作，学校决定从下月起……[详细]
- 会议指出，要把各项任务落到实处，……【阅读全文】
- 浏览次数：231
- 阅读次数：1024
- 点击数：77 次
- 访问量：100235
- 您是第 88231 位访客
- 本页面已被浏览 451 次
- 今日访问 12 总访问 35001
- 版权所有 © 2018 某某大学
- 版权所有：某某大学教务处 未经授权禁止转载
- 版权所有 © 某某学院 技术支持：网络中心
- Copyright © 2016 某某大学 All Rights Reserved
- © 2021 某某大学信息中心
- 京ICP备00000000号 京公网安备000000号
- 地址：某某市某某路12号 邮编：100000
- 地址：某某区大学路5号 电话：010-00000000 传真：010-00000001
- 邮编：200000 电话：021-00000000
- 联系电话：000-00000000 邮箱：office@college.example
- 凡本网注明来源的作品，版权均属于本网，未经许可不得转载。
- 转载请注明来源：某某大学新闻网
- 转载请注明来源：某某大学工会
- 转载请注明出处
- 首页|校园生活|考试中心|网络服务
- 首页|图书资源|馆藏目录|新书通报|读者服务|开放时间
- 您的位置: 首页 >> 校园生活 >> 关于调整校车时刻的通知
- 您的位置: 首页 >> 图书资源 >> 新书通报第3期
- 下一条：我校召开年度总结会
- 上一条：食堂改造工程侧记（3月2日）
- 下一篇：游泳馆开放日侧记（7月9日）
- 扫码关注校友会公众号
- 本站声明：本网转载的文章仅代表作者观点，与本站立场无关。
- 免责声明：外部链接的内容由其所有者负责。
- 网站地图 | 隐私政策 | 法律声明
- 友情链接：教育部 图书馆 校长信箱
- 技术支持：某某科技 建议使用 1024 分辨率浏览
- Home
- About
- People
- Admissions
- Academics
- Research
- Alumni
- Events
- News
- Contact
- Careers
- Home | About | People | News | Contact
- Home About Academics Research Alumni Contact
- Home · Research · Events · Jobs
- Log in | Register
- Log in | Sign up | 中文
- Sign in to comment
- Skip to content
- Skip to main content
- Back to top
- Search this site
- You are here: Home > News > Article
- You are here: Home » Events » Details
- Home > Research > Projects
- You are here: Home / Library / How to borrow a map
- Next: How the old bridge was repaired
- Previous: Choir sings at the town hall
- Home / News / 2017
- We use cookies to improve your visit. Accept all Reject
- This site uses cookies to improve your experience. [Accept] [Decline]
- Cookies help us understand how the site is used. Learn more
- By using this site you agree to our use of cookies.
- Share this: Facebook Twitter Email
- Share on Twitter
- Share | Print | Email
- Tell a friend | Print this page
- Print this page
- Print | Close window
- Follow us for more updates
- Follow us on Twitter and Facebook
- Subscribe to our newsletter
- Like this page
- Previous: Library announces winter hours
- Next: Students win national prize
- Previous: none Next: none
- « Previous Next »
- Previous article Next article
- Related news
- Related articles
- Related stories
- You may also like
- Latest news
- Latest posts
- Most read
- See also
- Read next
- Read more
- The college has opened a new hall for visitors and … [Read more]
- Members of the team spent a month in the field … More
- Views: 412
- Page views: 10233
- Visitors: 55012
- This page has been viewed 78 times
- © 2015 Some University
- © Department of Examples, Some University. All rights reserved.
- Copyright 2012-2019 Some College. All rights reserved.
- All rights reserved
- Terms of use | Privacy | Accessibility
- Terms of use | Privacy policy | Site map
- Privacy notice
- The university is not responsible for the content of external sites.
- Reproduction without written permission is prohibited.
- Address: 12 Some Street, Sometown 12345
- Some University, 5 College Road, Sometown. Tel. 000 0000000
- Tel: 000-0000 Fax: 000-0001 Email: office@college.example
- Powered by SomeCMS
- Webmaster | Feedback

+ 昨天下午，我校在大礼堂召开了新学期工作会议，全体中层干部参加了会议。
+ 校长在讲话中回顾了过去一年的工作，并对新一年的重点任务作了部署。
+ 张教授介绍了课题的研究背景、主要方法和初步结论。
+ 报告结束后，老师们围绕教学改革的问题进行了热烈讨论。
+ 本次比赛共有三十二支队伍报名，经过两轮角逐，八支队伍进入决赛。
+ “希望同学们珍惜时光，多读书，读好书。”她说。
+ 据介绍，该项目历时三年，投入经费五百余万元，已发表论文二十篇。
+ 讲座由图书馆主办，来自各院系的近百名学生到场聆听。
+ 参观结束后，代表们就合作办学进行了座谈，并签署了备忘录。
+ 申请者须于9月30日前将材料送交研究生院，逾期不予受理。
+ 名单公示五天，如有异议，请以书面形式向纪检部门反映。
+ 实验结果表明，新算法的速度比原来提高了两倍。
+ 问：这项工作最大的困难是什么？答：数据太少，而且质量不高。
+ 该书共十二章，系统讲述了古代建筑的营造方法，书后附有图版。
+ 由于线路检修，本周六上午办公楼将停电四小时，请提前做好准备。
+ 新生报到时间为8月25日至26日，请携带录取通知书和身份证。
+ 志愿者们清理了河岸的垃圾，向居民讲解了垃圾分类的知识。
+ 会议强调，要完善制度，加强监督，确保各项措施落到实处！
+ 论文比较了四种模型，否定了其中两种，并给出了改进的方向。
+ 学生代表发言时说，这次活动让自己对专业有了新的认识。
+ 作者所有的照片都由本人提供，版权者可在一个月内登记。
+ 新版首页增加了栏目，老用户可以在设置里换回原来的样子。
+ 研究者分析了分享按钮的位置对点击的影响，发现差别不大。
+ 发布时间：2018-03-05 来源：新闻中心 作者：李老师
+ 发布日期：2015-11-20 来源：教务处
+ 时间：2020年6月1日 10:30 来源：学院办公室
+ 2017-05-04 14:20 编辑：王同学
+ 作者：陈晨 摄影：刘洋
+ 日期：2012年12月8日
+ 供稿：学生会宣传部
+ 供稿：校团委通讯员
+ 供稿：外语系通讯员
+ 供稿：体检中心通讯员
+ 图文：离退休处宣传组
+ 图文：工会宣传组
+ 文字：校报记者 图片：宣传部
+ 管理员解释，Cookie 保存多久由用户决定，默认是三十天。
+ 当 x < 3 且 y > 5 时，方程没有实数解。
+ 馆长提醒，版权到期的作品可以复制，未到期的不得外借。
+ 供稿：后勤处 赵老师 2016-04-01
+ （通讯员 孙悦）
+ 责任编辑：周明
+ 编辑：吴老师 审核：郑主任
+ 图文：学生记者团
+ 撰稿：物理系 摄影：校报
+ 附件：申请表.doc
+ 附件1：评审细则.pdf
+ 附件：名额分配表3.xlsx
+ 附件下载：报名表.docx
+ 主讲人：何教授
+ 地点：第二教学楼201
+ The dean opened the meeting and thanked everyone who had helped to prepare it.
+ Professor Green explained how the method works and where it fails.
+ About forty students from six departments took part in the discussion.
+ "We learned more from the mistakes than from the results," she said.
+ The team tested three designs over eleven months and kept the cheapest.
+ Applications must reach the office by 15 March; late forms will not be accepted.
+ Results improved by a third, and the cost fell by half.
+ Doors open at nine and the lecture is free for all members.
+ The library bought two hundred books on the subject, all of them kept in the west wing.
+ Grant AB-12 supports two years of research into old maps.
+ The two museums agreed to share their catalogues.
+ Funding covers four years of work and two positions.
+ Why does the question matter? Because nobody has measured it before.
+ Winners will spend a summer at the institute with a tutor.
+ The panel compared six answers, and rejected most of them.
+ A clinic on privacy and copyright drew many readers to the hall.
+ The new home page lists events first; the old one can still be chosen.
+ Her study of cookies and sharing buttons found no effect on visits.
+ Published: 5 May 2016 | By Anna Smith
+ Posted on 12 June 2019 by the press office
+ 3 April 2014, Communications Office
+ By John Miller, Faculty of Science
+ Text: Mary Brown. Photo: Students' Union
+ Contributed by the Department of History
+ Edited by the news desk
+ Attachment: application form.pdf
+ Attachment 2: guidelines.docx
+ Speaker: Dr Jane White
+ Venue: Main Building, Room 12

= 我校召开新学期工作会议
= 关于举行2019年春季运动会的通知
= 数学系举办学术沙龙
= 王教授谈青年教师的成长
= 我校学子在全国竞赛中获一等奖
= 图书馆暑期开放时间安排
= “读书月”系列活动预告
= 化学学院赴兄弟院校调研
= 教务处关于缓考申请的说明
= 新食堂落成仪式侧记
= 优秀毕业论文名单公示
= 院长访问海外高校
= [03/15] 关于调整作息时间的通知
= [2016-05-06] 我校与企业签署协议
= 学生社团举办摄影展 2017-10-11
= 后勤服务满意度调查 2019/01/02
= Students win national prize
= Workshop on old maps opens at the museum
= How bridges learn to bend
= Call for papers: autumn conference
= Professor Green speaks about rivers
= Library announces winter hours
= Notes from the field station
= New laboratory opens at the School of Medicine
= [04/05] Call for proposals
= Exhibition of student work opens 2018-06-07
"""
