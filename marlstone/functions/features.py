"""Features of an article's text. Each function gives SQL for a dialect ``d`` over expressions."""

from __future__ import annotations

#: Words that tell an action.
ACTIONS = [
    "发布", "收购", "并购", "兼并", "裁员", "批准", "禁止", "上调", "下调", "降息", "加息", "涨停", "跌停", "上市", "退市", "起诉",
    "破产", "盈利", "亏损", "营收", "签约", "合作", "投资", "减持", "增持", "分红", "回购", "合并", "重组", "违约", "中标", "获批",
    "立案", "罚款", "警告", "停产", "扩产", "减产", "袭击", "空袭", "爆炸", "冲突", "停火", "封锁", "撤军", "扣押", "拦截", "干预",
    "谈判", "洽谈", "达成", "签署", "中断", "恢复", "开放", "关闭", "宣布", "声明", "表态", "要求", "承诺", "加征", "减征", "释放",
    "暴涨", "暴跌", "走强", "走弱", "创新高", "创新低", "加剧", "放缓", "扩张", "acquire", "merge", "layoff",
    "approve", "ban", "raise", "cut", "launch", "sue", "bankrupt", "earn", "guidance", "buyback",
    "recall", "default", "ipo", "listing", "settlement", "strike", "attack", "ceasefire",
    "blockade", "intervene", "negotiate", "announce", "pledge", "halt", "resume", "seize", "surge",
    "plunge",
]
#: Words that tell a policy or a filing.
POLICIES = [
    "政策", "监管", "法规", "公告", "财报", "指引", "利率决议", "关税", "制裁", "反垄断", "ipo", "重组", "股权激励", "配股", "定增",
    "法案", "条例", "通知", "指导意见", "规划", "白皮书", "决议", "policy", "regulation", "filing", "earnings",
    "guidance", "rate decision", "tariff", "sanction", "antitrust", "ruling", "mandate",
]
#: Words of major events.
MAJOR = [
    "重大并购", "破产", "退市", "诉讼", "业绩预告", "业绩指引", "利率决议", "降息", "加息", "关税", "制裁", "产业政策", "反垄断", "违约",
    "重组", "重大合同", "major acquisition", "bankruptcy", "lawsuit", "earnings guidance",
    "rate decision", "tariff", "sanction", "antitrust",
]
#: Core topics.
TOPICS = [
    "宏观", "货币", "利率", "股市", "债券", "美联储", "央行", "财报", "半导体", "人工智能", "ai", "能源", "油价", "关税", "地缘",
    "科技", "并购", "经济", "gdp", "通胀", "就业", "芯片", "新能源", "电动车", "上市公司", "ipo",
]
#: Marks of adverts.
ADVERTS = [
    "报名", "优惠", "促销", "限时", "抢购", "免费领取", "立即下载", "扫码", "关注我们", "点击购买", "加盟", "招募", "webinar",
    "podcast", "newsletter", "sponsored", "subscribe", "discount", "buy now", "免费试用", "限时特惠",
]
#: Marks of vague opinions.
VAGUE = [
    "业内人士认为", "分析称", "或", "可能", "有望", "预计", "猜测", "传言",
]
#: Patterns of texts of low value.
LOW_VALUE = [
    "报名开启", "直播预告", r"播客第\d+期", "本周精选", "招聘|加入我们|诚聘|招募", "sponsored|partner content|广告",
    "webinar|podcast|newsletter", "限时优惠|免费领取|立即下载|扫码关注|点击购买|优惠促销", "课程推广|训练营|公开课",
]
#: Names of official sources.
OFFICIAL_NAMES = [
    "美联储", "央行", "人民银行", "证监会", "交易所", "国家统计局", "财政部", "发改委", "工信部", "商务部", "Federal Reserve",
    "Fed", "SEC", "Treasury", "ECB", "PBOC", "CSRC", "HKEX", "SSE", "SZSE",
]
#: Domains of official sources.
OFFICIAL_DOMAINS = [
    ".gov", ".gov.cn", "sec.gov", "hkex.com.hk", "hkexnews.hk", "sse.com.cn", "szse.cn",
    "cninfo.com.cn", "pbc.gov.cn", "mof.gov.cn", "stats.gov.cn", "ndrc.gov.cn", "miit.gov.cn",
    "mofcom.gov.cn", "federalreserve.gov", "treasury.gov", "ecb.europa.eu",
]
#: What a number, an entity and a date look like.
NUMBER = r"[0-9]|[一二三四五六七八九十百千万亿两]+\s*(%|％|成|倍|艘|架|家|个|亿|万|元|美元|人|次|年|月|日|天|点)"
#: Fixed value: a number with what it counts.
AMOUNT = r"[0-9][0-9,\.]*\s*(?:%|％|亿|万|万亿|元|美元|欧元|英镑|\$|bn|mn|trn|k|m|b|percent|pts|点)?|[一二三四五六七八九十百千万亿两]+\s*(?:%|％|成|倍|艘|架|家|个|亿|万|元|美元|人|次|年|月|日|天|点)"
ENTITY = r"[A-Za-z]{3,}|[\x{4e00}-\x{9fff}]{2,}(公司|集团|银行|央行|政府|部|局|委员会|研究院|交易所|省|署|厅|办公室|协会|通讯社|电视台|组织|基金|财团|大学|机构|管理局|监管局)|(?m:^\s*据?[^：:\n]{2,14}[：:])"
DATES = r"今日|昨日|本周|本月|季度|Q[1-4]|20\d{2}年|\d{1,2}月\d{1,2}日|明年"


def has(d, low: str, words: list[str]) -> str:
    """Whether ``low``, a text in lower case, holds any of these words."""
    return d.any_in(low, [w.lower() for w in words])


def official(d, source: str, url: str) -> str:
    return f"({has(d, f'lower({source})', OFFICIAL_NAMES)} OR {has(d, f'lower({url})', OFFICIAL_DOMAINS)})"


def hard_signal(d, x: str, low: str) -> str:
    """A number, an entity and an action count one each, a policy or filing two; ``low`` is ``x`` in lower case."""
    point = lambda cond, n=1: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
    return f"({point(d.rx(x, NUMBER))} + {point(d.rx(x, ENTITY))} + {point(has(d, low, ACTIONS))} + {point(has(d, low, POLICIES), 2)})"


def low_value(d, title: str, content: str, hard: str) -> str:
    """Name of the first rule that an article fails, else null."""
    scan = f"({title} || ' ' || substring({content}, 1, 200))"
    rules = [
        (f"length({title}) < 8 AND length({content}) < 80", "incomplete"),
        (f"length({title}) > 0 AND contains({content}, {title}) AND length({content}) - length({title}) < 20 AND length({title}) < 24 AND {hard} = 0", "title_only"),
        *((d.rx(scan, "(?i)" + p), f"pattern{i}") for i, p in enumerate(LOW_VALUE, 1)),
    ]
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for cond, name in rules) + " END"


def prefilter_score(d, x: str, low: str, tier: str) -> str:
    """Two for an entity, number and action each, the weight of the tier, one for a core topic, less three for an advert and two for an opinion without numbers; 0 at least."""
    point = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
    parts = [point(d.rx(x, ENTITY), 2), point(d.rx(x, NUMBER), 2), point(has(d, low, ACTIONS), 2), f"CASE {tier} WHEN 'A' THEN 2 WHEN 'B' THEN 1 WHEN 'C' THEN 0 WHEN 'D' THEN -1 ELSE 1 END", point(has(d, low, TOPICS), 1)]
    return f"greatest(0, {' + '.join(parts)} - {point(has(d, low, ADVERTS), 3)} - {point(f'{has(d, low, VAGUE)} AND NOT {d.rx(x, NUMBER)}', 2)})"


def news_beside(d, x: str, root: str) -> str:
    """Whether text ``x`` has other numbers than ``root``, or entities, actions or dates that ``root`` lacks."""
    words = "|".join(ACTIONS)
    found = lambda y, pattern: d.every(y, pattern)
    trimmed = lambda y: d.distinct(found(y, AMOUNT))
    lacks = lambda a, b: f"{d.missing(a, b)} > 0"
    parts = [f"{trimmed(x)} != {trimmed(root)}", lacks(found(x, ENTITY), found(root, ENTITY)), lacks(found(f"lower({x})", words), found(f"lower({root})", words)), lacks(found(x, DATES), found(root, DATES))]
    return "(" + " OR ".join(parts) + ")"
