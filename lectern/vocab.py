"""Word lists and limits that results depend on."""

# Topics with the words that put a section under them, in the order of the topics.
TOPIC_BUCKETS = {
    "登录": ["登录", "注册", "账号", "密码", "验证码", "退出"],
    "设备": ["设备", "电站", "绑定", "添加", "解绑", "分组", "站点"],
    "监控": ["监控", "实时", "曲线", "数据", "SOC", "功率", "运行状态", "首页"],
    "告警": ["告警", "报警", "故障", "异常", "事件", "提醒"],
    "报表": ["报表", "统计", "导出", "下载", "历史数据"],
    "权限": ["权限", "角色", "用户管理", "组织", "成员"],
    "工单": ["工单", "维修", "派工", "验收", "安装维修"],
    "反馈": ["反馈", "帮助中心", "产品咨询", "产品问题"],
    "场站": ["场站", "建站", "站点", "SN", "防逆流", "工作模式"],
    "概述": ["概述", "简介", "功能", "平台介绍", "使用说明", "模块", "操作指南"],
}
# Patterns of questions that ask for a topic.
TOPIC_TRIGGERS = {
    "登录": "登录|注册|账号|密码|验证码|忘记密码|退出登录|怎么登|如何登",
    "设备": "添加设备|绑定设备|设备管理|解绑|新建电站|站点|分组|怎么添加",
    "监控": "监控|实时数据|运行状态|曲线|SOC|功率|首页|怎么看数据|数据查看",
    "告警": "告警|报警|故障|异常|事件|提醒|怎么处理|如何排查",
    "报表": "报表|统计|导出|下载|历史数据|数据导出",
    "权限": "权限|角色|用户管理|组织|成员|账号管理",
    "工单": "工单|维修|派工|验收|安装维修",
    "反馈": "反馈|帮助中心|产品咨询|产品问题",
    "场站": "场站|建站|站点|SN码|防逆流|工作模式",
    "概述": "平台介绍|功能介绍|是什么|怎么用|使用说明|模块介绍|操作指南",
}
# Queries added for a topic of which the collection has no section.
TOPIC_FALLBACK = {
    "登录": ["登录", "注册", "忘记密码", "账号"],
    "设备": ["设备管理", "添加设备", "绑定", "电站"],
    "监控": ["监控", "实时数据", "运行状态", "首页"],
    "告警": ["告警", "报警", "故障", "事件"],
    "报表": ["报表", "统计", "导出", "历史数据"],
    "权限": ["权限", "角色", "用户管理"],
    "工单": ["工单", "新增工单", "维修", "验收"],
    "反馈": ["反馈", "帮助中心", "产品咨询"],
    "场站": ["创建场站", "建站", "场站设置", "SN码"],
    "概述": ["平台介绍", "功能介绍", "使用说明", "操作指南"],
}
# Words in a title that raise it for a topic, and words that lower it.
TOPIC_BOOST = {
    "登录": ["登录", "注册", "密码", "账号", "验证码"],
    "设备": ["设备", "绑定", "添加", "电站", "站点", "分组"],
    "监控": ["监控", "实时", "曲线", "数据", "SOC", "功率", "首页"],
    "告警": ["告警", "报警", "故障", "异常", "事件", "排查"],
    "报表": ["报表", "统计", "导出", "下载", "历史"],
    "权限": ["权限", "角色", "用户", "组织", "成员"],
    "概述": ["概述", "介绍", "功能", "说明", "模块"],
}
TOPIC_OFF = {
    "登录": ["报表", "导出", "权限"],
    "设备": ["登录", "注册", "报表"],
    "监控": ["登录", "注册", "权限"],
    "告警": ["登录", "注册", "报表导出"],
    "报表": ["登录", "注册", "密码"],
    "权限": ["监控", "曲线", "SOC"],
}
# Introductory questions, titles that answer them, titles of little value, and queries added for them.
INTRO_QUERY = "介绍|概述|概况|是什么|什么样|功能|特点|用途|简介|讲讲|说说|这个平台|平台怎么用"
OVERVIEW_TITLES = ["平台介绍", "功能介绍", "使用说明", "概述", "简介", "模块", "首页"]
LOW_VALUE_TITLES = ["目录", "修订记录", "版本记录"]
SKIPPED_TITLES = "^目录|修订记录|版本记录"
INTRO_SUFFIX = " 平台介绍 功能介绍 使用说明 模块"
INTRO_EXTRA = "平台概述 功能模块 首页 使用指南"
# Titles by kind of block, and kinds of chunks by pattern, the first that matches.
TOC_TITLES = ["目录"]
WARNING_TITLES = ["告警", "注意", "危险", "警告", "小心", "A 告警", "！ 告警"]
FRONT_TITLES = ["商标", "软件授权", "读者对象", "产品服务及咨询", "手册警示符号", "机体警示标贴", "修订记录", "订货说明：", "订货说明"]
CHUNK_TYPES = [
    ("产品概述|外观|机械参数|内部设计|产品描述|LED", "overview"),
    ("安装|固定|运输|起吊|吊装|叉车|地基|地点", "procedure"),
    ("接线|端子|接地|等电位|铜线|热缩", "procedure"),
    ("上电|下电|开机|停机|投运", "procedure"),
    ("维护|更换|检修|保养|清洁", "maintenance"),
    ("故障|事件|排查|告警码", "troubleshoot"),
    ("安全|危险|警告", "safety"),
    ("参数|规格|接口|布局|概述", "spec"),
]
# Limits of chunking, ranking and context.
MAX_CHUNK_TOKENS = 800
MIN_BODY_CHARS = 80
MIN_SCORE = 0.15
SCORE_GAP, MIN_KEEP = 0.25, 2
TOP_K = 6
TOPIC_TITLES = 3
ALIAS_BOOST = 0.15
FUSION_ALPHA = 0.5
RERANK_CANDIDATES, RERANK_CHARS = 15, 512
SHORT_BODY, SHORT_CONTEXT = 80, 60
MIN_IMAGE_SIDE, MAX_IMAGES = 80, 5
HISTORY_TURNS = 6
SNIPPET_CHARS, RESPONSE_CHARS = 300, 500
# Wording of the context that a model is shown, of its prompts, and of answers without one.
CONTEXT_HEAD = "以下片段按相关度排序，请围绕用户问题筛选整合，不必全部写入回答。\n"
CONTEXT_IMAGES = "随附视觉输入共 %d 张，顺序与编号一致："
FRAGMENT_IMAGES = "配图（回答中请用 [图-N] 占位符紧跟对应段落后插入，勿写 URL）:\n"
FRAGMENT_HEAD, FRAGMENT_SECTION, FRAGMENT_SCORE, FRAGMENT_BODY = "--- 片段 %d ---\n产品: ", "\n章节: ", "\n相关度: %.3f\n", "内容:\n"
IMAGE_PLACE, IMAGE_PLACE_END = " [随附视觉输入第", "张]"
UNKNOWN, ALL_PRODUCTS = "未知", "全部产品"
ASK, ASK_FRAGMENTS, ASK_PRODUCT = "用户问题：\n", "\n\n检索到的{subject}片段：\n", "当前选定文档："
ASK_END = "\n\n请整合以上片段围绕用户问题作答。"
ASK_PRODUCT_END = "\n\n请整合以上片段（及随附图片，如有）围绕用户问题作答。引用处在句末标注 *(章节: xxx)*。"
ASK_HISTORY = "\n\n对话历史：\n"
BLANK_QUESTION = "请输入问题。"
NO_RESULT = "未在{subject}中找到相关信息。请尝试换一种问法，或确认问题是否属于平台操作范围。"
