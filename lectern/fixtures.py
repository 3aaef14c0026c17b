"""Small inline tables for markup and Chinese text that the standard tables lack, as SQL that Spark and DuckDB both read."""

from __future__ import annotations


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, list):
        return f"split({literal(';'.join(value))}, ';')"
    parts = value.replace("'", "''").replace("\\", "\0").split("\n")
    text = " || chr(10) || ".join("'" + p.replace("\0", "' || chr(92) || '") + "'" for p in parts)
    return f"({text})"


def values(columns: str, rows: list[tuple]) -> str:
    """SELECT statement of a constant table."""
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


_LONG = "这一节说明界面上各个区域的作用，以及在日常使用时如何逐项核对运行参数并记录结果，便于之后排查问题。" * 2
MANUALS = values("doc_id, md_stem, text", [
    (1, "手册甲", f"封面文字\n第二行\n# 目录\n1 概览....3\n# 1 概览···· 3\n# 3 安装\n{_LONG}\n# 3.4 固定\n{_LONG}\n## 小标题\n内容\n# 注意\n请勿带电操作\n# 3.4.1 底座\n![图](images/a.png)\n# 3.4.2 支架\n{_LONG}\n# 3.5 接线\n{_LONG}<TABLE><tr></tr></TABLE>\n# 修订记录\nV1\n# 短节\n短\n# 账号登录\n{_LONG}"),
    (2, "手册乙", f"# 1. 开机操作\n{_LONG}\n# 2.关机操作\n短\n# 页眉文字\n\n# 4 维护\n{_LONG}\n# 4.1 清洁\n{_LONG}\n# 3 旧节\n{_LONG}"),
    (3, "手册丙", ""),
    (4, "手册丁", "没有标题的文字"),
    (5, "手册戊", "\n\n# 平台介绍\n" + _LONG + "\n图 1-1 首页\n![a](x/y/首页.png)\n\n\n\n![b]( images/b.jpg )\n# 监控数据\n" + _LONG),
])
PAGE_HEADERS = ["页眉文字"]
TITLES = values("id, title", [(k, t) for k, t in enumerate(["目录", " 目录 ", "注意", "A 告警", "页眉文字", "商标", "订货说明：", "3.5 固定安装", "3.5 固定安装···· ··29", "3.5 固定....29", "1. 登录", "2.注册", "3  多空格", "4.6.2 接线 ", "概述", "", "3.", "10 参数 2024"])])
OVERSIZE = values("chunk_id, content", [
    (1, "步骤1 打开\n做一\n  步骤 2 关闭\n做二\n步骤3 结束"), (2, "引言\n步骤 1 开始\n内容"), (3, "一 二 三\n\n四 五 六\n\n七 八 九 十"), (4, "一 二\n\n \n三 四\n\n\n五"), (5, "短文"), (6, "一二三四五六七八九十一二三四五六七八"), (7, "\n\n一\n\n二三四五六七八九\n\n十"),
])
QUERIES = values("query_id, text, product_id", [
    (1, "怎么登录平台", None), (2, "添加设备失败怎么处理", "p1"), (3, "平台介绍", "p1"), (4, "户用系统导出报表", ""), (5, "权限和角色", "p2"), (6, "工单在哪", None), (7, "反馈入口", None),
    (8, "场站创建", "p1"), (9, "SOC曲线", None), (10, "这是什么", "p2"), (11, "无关问题", None), (12, "查看 ABC-X 数据", None), (13, "", None),
])
PRODUCTS = values("product_id, display_name, md_stem, manual_pdf, aliases, series_id, series_name", [
    ("p1", "户用系统指南", "手册甲", "甲.pdf", ["户用系统", "系统指南", ""], "s1", "户用"), ("p2", "商用系统", "手册乙", "乙.pdf", ["abc-x", "系统"], "s1", "户用"), ("p3", "第三产品", "手册戊", "戊.pdf", [" 第三 "], "s2", "其他"),
])
SECTIONS = values("product_id, pos, section_title, section_path, chunk_type", [
    ("p1", 1, "目录", "目录", "toc"), ("p1", 2, "登录", "1 账号 > 1.1 登录", "general"), ("p1", 3, "重置密码", "重置密码", "general"), ("p1", 4, "登录", "登录", "general"), ("p1", 5, "退出", "退出", "general"), ("p1", 6, "注册账号", "注册账号", "general"),
    ("p1", 7, "监控首页", "监控首页", "general"), ("p1", 8, "修订记录", "登录修订记录", "general"), ("p1", 9, "", "登录", "general"), ("p2", 1, "报表导出", "报表导出", "general"), ("", 1, "登录", "登录", "general"), ("p2", 2, "商标", "商标", "meta"),
])
RANKED = values("query_id, chunk_id, section_title, content, image_paths, score, is_intro, bucket", [
    (1, 1, "平台介绍", _LONG * 2, ["images/a.png"], 0.9, True, None), (1, 2, "登录", _LONG * 2, ["a"], 0.6, True, "登录"), (1, 3, "报表", _LONG * 2, ["a"], 0.5, False, "登录"), (1, 4, "目录页", _LONG * 2, ["a"], 0.3, False, "登录"),
    (1, 5, "其他", "短", None, 0.2, False, "登录"), (2, 6, "登录与报表", "短 <Table>", None, 0.95, False, "报表"), (2, 7, "注册", _LONG * 2, None, 0.1, False, "报表"), (2, 8, "修订记录", "短", None, 0.7, False, "工单"), (2, 9, "曲线", _LONG, None, 0.72, False, "概述"), (3, 10, "x", _LONG * 2, None, 0.1, False, None),
])
IMAGES = values("query_id, chunk_rank, pos, rel_path, width, height, content, section_title", [
    (1, 1, 0, "images/d/a.png", 200, 200, "图 1-2 登录\n图3 注册 后面\n其他", " 节一 "), (1, 1, 1, "images/d/icon.png", 79, 200, "图 1-2 登录\n图3 注册 后面\n其他", "节一"), (1, 1, 2, "images/d/b.png", None, None, "图 1-2 登录\n图3 注册 后面\n其他", "节一"),
    (1, 2, 0, "images/d/a.png", 200, 200, "无图", "节二"), (1, 2, 1, "images/d/c.png", 80, 80, "无图", "节二"), (1, 3, 0, "images/d/e.png", 99, 99, "图 9", "节三"), (1, 3, 1, "images/d/f.png", 99, 99, "图 9", "节三"), (1, 3, 2, "images/d/g.png", 99, 99, "图 9", "节三"), (2, 1, 0, "d/z.jpg", 100, 100, "", ""),
])
URLS = values("id, raw", [(k, u) for k, u in enumerate(["http://x.org/a b.png", "/kb_images/doc-1/a.png", "kb_images/doc-1/a.png", "images/doc-1/图 1~*.png", "images\\doc-1\\b.png", " doc-ab/cd.jpg ", "https://host.example/kb_images/doc-ab12/cd34.PNG", "https://host.example/other/doc-ab12/cd34.webp", "plain text", "", "/a+b@c:d.png"])])
ANSWERS = values("id, answer, image_id, display_url, caption_hint", [
    (1, "见 [图-1] 与 [图-2]。", "图-1", "/kb_images/doc-1/a.png", "登录页"), (2, "![x](https://bad.example/kb_images/doc-ab/cd.png) 和 [图-1]", "图-1", "images/doc-1/a.png", ""), (3, "裸 https://h.example/doc-ab/cd.jpg 引用", "图-9", "/kb_images/q.png", "q"), (4, "没有图", "图-1", "u", "c"),
])
SSE = values("request_id, seq, raw", [
    (1, 1, "event: delta\ndata: {\"a\":"), (1, 2, " 1}\n\ndata: {\"b\": 2}\n\nevent: done\nda"), (1, 3, "ta: {}\n\ntail"), (2, 1, "data: nonsense\n\ndata: [1,\ndata: 2]\n\n"), (3, 1, "partial"),
])
STREAM = values("request_id, seq, line", [
    (1, 1, 'data: {"candidates":[{"content":{"parts":[{"text":"你"},{"text":"好"}]}}]}'), (1, 2, "data: [DONE]"), (1, 3, "bad json"), (1, 4, '[{"candidates":[{"content":{"parts":[{"text":"，"}]}}]},{"candidates":[{"content":{"parts":[{"text":"世界"}]}}]}]'), (2, 1, ""), (2, 2, '{"other":1}'),
])
METADATA = values("id, raw", [(k, u) for k, u in enumerate(["a; b ;;c", '["x", " y ", ""]', "", " ", "[broken", "single", None])])
DOCX = values("pos, style, line", [(k, s, t) for k, (s, t) in enumerate([("Heading1", "一"), ("Heading 9", "九"), ("Title", "题"), ("标题", "题"), ("Normal", "3.2登录"), ("", "关机操作"), ("", "·操作"), ("", "这是一行很长的说明文字不是标题操作"), ("", ""), ("HeadingX", "工单"), ("Heading", "2. x"), (None, "点击操作")])])
SNAPSHOTS = values("product_id, sha256, mtime, old_sha, old_mtime, old_doc, configured", [
    ("same", "h1", 1.0, "h1", 1.0, "doc-1", True), ("hash", "h2", 1.0, "h1", 1.0, "doc-2", True), ("time", "h1", 2.0, "h1", 1.0, "doc-3", True), ("gone", None, None, "h1", 1.0, "doc-4", True), ("dropped", None, None, "h1", 1.0, "doc-5", False), ("fresh", "h9", 1.0, None, None, None, True), ("nofile", None, None, None, None, None, True), ("nodoc", "h1", 1.0, "h1", 1.0, None, True),
])
TABLES = values("id, a, b, c", [(1, ["h1", "h2"], ["x y", "z"], ["1"]), (2, ["only"], ["r"], ["q", "w"])])
