"""Labelled documents for the field of ``pii``, made from patterns with a fixed seed."""

from __future__ import annotations

import random

COMMON_SURNAMES = "王李张马谢方高"
RARE_SURNAMES = "郝侯邹孟秦阎薛闫雷龙黎尹"
TWO = ("欧阳", "司马", "诸葛", "上官")
GIVEN = "琪瑶婷雯霖旭睿涵泽淇铭骞琛妍姝璇瑾翰钰晗"
EN_GIVEN = ("Anselm", "Beatrix", "Cedany", "Dorian", "Elspeth", "Florian", "Gwenda", "Hollis", "Imogen", "Jarvis")
EN_FAMILY = ("Ashgrove", "Birchwood", "Crowhurst", "Daventry", "Elmsford", "Foxcroft", "Greyling", "Harrowgate", "Kestrel", "Lockhart")
ROADS = ("Maple", "Station", "Church", "Mill", "Orchard")
STREET = ("Road", "Street", "Lane", "Avenue", "Drive")
TOWNS = ("Eastvale", "Port Merrow", "Little Haven", "Stoneford")
ZH_ROADS = ("青石", "长安", "文化", "梧桐")
ZH_TOWNS = ("海丰", "金城", "云山")
FILLER_ZH = ("今天的天气不错。", "这个问题大家讨论过很多次了。", "我觉得还是要看情况，别着急。", "周末打算去爬山。")
FILLER_EN = ("The weather was fine today. ", "We talked about it many times. ", "I think it depends on the case. ", "They saw 3 kinds of road last year. ")

#: Given characters that are frequent in any text, and sentences in which family names are parts of words.
USUAL = "国强建军明伟志海天小雨文华生家大心学"
OTHER_COMMON = "好看想行点作成道理面定"
ORDINARY = (
    "周末打算去爬山。", "一周后再看。", "非常大的变化。", "平时常去那里。", "范围很广。", "水平不高。", "何况我没有去。", "尤其是这样。", "麻烦在于时间。", "几十元的价格。", "高原的天气。", "高兴得很。", "乐队来了。", "方程的解。", "方法很多。", "用金的做。", "云的形状。", "马上就去。", "万一不行呢？",
    "安全第一。", "通常会好。", "常见的问题。", "许多人都说好。", "和平时一样。", "方便的话。", "任何人都行。", "张开嘴。", "季节变了。", "温度不高。", "黄色的花。", "史料很少。", "项目完成了。", "强调一下。", "路上小心。", "路线很长。", "于是他走了。", "白云在天上。", "江水很大。", "这方面不懂。", "平常心就好。", "花时间学。", "花生好吃。", "康复得很快。", "周期很长。",
    "水面很平。", "国家安定。", "地方文学。", "周天再说。", "金文很难懂。", "古文化很多。", "平等看待。", "上方有人。", "石家庄大道。", "毛病不少。", "时常想起。", "皮面很好。", "成为作家。", "汤好喝，", "苗长得好，", "席上都是客人，", "席是新的，", "水生植物。", "云海很美。", "高明的人。", "安心学习。", "平生第一次。", "方向盘。", "马路对面。", "万里无云。", "夏天很热。", "明天见。", "雷雨天气。", "花心思。", "华文学校。", "严明的纪律。", "成都很远。",
    "尤其大约三次。", "尤其在夏天，", "周期大约三年。", "花时大约一天，", "高原反应。", "方程在书里。", "江口市很远。", "水平在上升。", "范围还在变大。", "麻烦还在后面。", "康复后再说。", "何况还有他。", "在江口市待过。", "管辖权的来源，", "方志的效果。",
)
#: Those of their pairs that stand for words of many texts; the others are as rare as names.
WORDS = frozenset("周末 一周 非常 平时 范围 水平 何况 尤其 麻烦 元的 高原 高兴 乐队 方程 方法 马上 万一 安全 通常 常见 许多 和平 方便 任何 季节 温度 黄色 史料 项目 路上 路线 江水 方面 平常 花时 花生 康复 周期 水面 地方 毛病 时常 夏天 雷雨 马路 方向 安心 成都 明天".split())


def _date(r: random.Random) -> str:
    return f"{r.randint(1950, 2005)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"


def _idnum(r: random.Random) -> str:
    head = f"{r.randint(110000, 659999)}{_date(r)}{r.randint(0, 999):03d}"
    check = "10X98765432"[sum(int(d) * (2 ** (17 - k) % 11) for k, d in enumerate(head)) % 11]
    tail = check if r.random() < 0.7 else str(r.randint(0, 9))
    shape = r.random()
    if shape < 0.6:
        return head + tail
    if shape < 0.8:
        return f"{head[:6]} {head[6:14]} {head[14:]}{tail}"
    return head[:6] + head[8:14] + head[14:17]


def _phone(r: random.Random) -> str:
    a, b, c = r.choice(("139", "158", "177")), f"{r.randint(0, 9999):04d}", f"{r.randint(0, 9999):04d}"
    return r.choice((a + b + c, f"{a}-{b}-{c}", f"{a} {b} {c}", f"+86 {a}{b}{c}", f"0086-{a}{b}{c}", f"010-5550{b}", f"(010) 5550{b}", f"555-555-{c}", f"(555) 555-{c}", f"+1 555 555 {c}", f"07700 900{r.randint(0, 999):03d}"))


def _email(r: random.Random) -> str:
    user, host = r.choice(("lena.k", "mail_bot", "t-rex9", "joe+news")), r.choice(("post.example", "a.test", "team.invalid"))
    return r.choice((f"{user}@{host}", f"{user}@{host}".upper(), f"{user} (at) {host}", f"{user} at {host.replace('.', ' dot ')}", f"{user}#{host}"))


def _number(r: random.Random) -> str:
    return r.choice((_idnum(r), f"{r.choice('ABCEGK')}{r.choice('KXPZ')}{r.randint(10**6, 10**7 - 1)}", f"9{r.randint(10, 99)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", f"QX{r.randint(10**5, 10**6 - 1)}C"))


def _zh_name(r: random.Random) -> str:
    family = r.choice(TWO) if r.random() < 0.2 else r.choice(COMMON_SURNAMES if r.random() < 0.3 else RARE_SURNAMES)
    return family + "".join(r.choice(GIVEN) for _ in range(r.choice((1, 2, 2))))


def _en_name(r: random.Random) -> str:
    given, family = r.choice(EN_GIVEN), r.choice(EN_FAMILY)
    return r.choice((f"{given} {family}", f"{given} {family}", f"{given} {r.choice('ABKM')}. {family}", f"{family}, {given}", f"{given} {family}".upper()))


def _zh_address(r: random.Random) -> str:
    place = r.choice(("", f"{r.choice(ZH_TOWNS)}市", f"{r.choice(ZH_TOWNS)}省{r.choice(ZH_TOWNS)}市", f"{r.choice(ZH_TOWNS)}区"))
    return f"{place}{r.choice(ZH_ROADS)}{r.choice(('路', '街', '大道', '巷'))}{r.randint(1, 300)}号"


def _en_address(r: random.Random) -> str:
    flat = f"Flat {r.randint(1, 20)}, " if r.random() < 0.2 else ""
    text = f"{flat}{r.randint(1, 300)} {r.choice(ROADS)} {r.choice(STREET)}"
    if r.random() < 0.2:
        text = text.lower() if not flat else text
    return text + (f", {r.choice(TOWNS)}" if r.random() < 0.5 else "")


#: (before, kind or None, after); kind None stands for text that is no case.
POSITIVE = (
    ("电话", "phone", "，下午在。"), ("加我微信同号", "phone", "。"), ("可以打", "phone", "问问。"), ("", "phone", "（晚上别打）"), ("这样也行（", "phone", "），就这样。"), ("Call ", "phone", " after six. "),
    ("Text me: ", "phone", ". "), ("it is messy (", "phone", "), of course. "), ("邮箱", "email", "，备注来意。"), ("Write to ", "email", " and I will answer. "), ("", "email", " works best. "), ("这样也行——", "email", "。"),
    ("身份证号", "idnum", "被抄了。"), ("证件号：", "idnum", "。"), ("护照号码", "idnum", "请勿外传。"), ("ID card no. ", "idnum", " was copied. "), ("这样也行（", "idnum", "），就这样。"), ("it is messy - ", "idnum", ". "),
    ("地址：", "zh_address", "。"), ("我住", "zh_address", "，欢迎来。"), ("请送到", "zh_address", "，谢谢。"), ("我们在", "zh_address", "碰面。"), ("I live at ", "en_address", ", drop by. "), ("Send it to ", "en_address", ". "), ("it is messy [", "en_address", "], then. "),
    ("收件人", "zh_name", "，谢谢。"), ("联系人", "zh_name", "。"), ("我跟", "zh_name", "在那里。"), ("", "zh_name", "还是愿意去。"), ("。", "zh_name", "当时不懂。"), ("姓名：", "zh_name", "。"), ("这样也行（", "zh_name", "），就这样。"), ("这件事", "zh_name", "聊过。"), ("钥匙在", "zh_name", "手里。"), ("署名：", "zh_name", "（本人）"), ("这样也行 ", "zh_name", " ，对吧。"), ("这样也行——", "zh_name", "，对吧。"), ("这样也行 ", "zh_address", " ，对吧。"), ("这样也行（", "zh_address", "），对吧。"), ("这样也行 ", "phone", " ，对吧。"), ("带我的是", "zh_name", "。"), ("感谢", "zh_name", "的提醒。"), ("等到看天气时", "zh_name", "其实后悔。"), ("那天", "zh_name", "没有来。"), ("收藏了", "zh_name", "常常不懂。"), ("，", "zh_name", "收。"), ("我叫", "zh_name", "，做这行八年。"), ("按经验，", "zh_name", "入秋一直在看天气。"),
    ("Thanks to ", "en_name", " for the help. "), ("Dr. ", "en_name", " explained it. "), ("Ask ", "en_name", " about it. "), ("My name is ", "en_name", " and I did it. "), ("", "en_name", " kept asking. "), ("", "en_name", " (see below) wrote it. "), ("Nobody told ", "en_name", " until then. "), ("Regards, ", "en_name", "\n"), ("it is messy (", "en_name", "), then. "),
)
NEGATIVE = (
    "订单号{o}查不到。", "书号 978-0-00-{d6}。", "时间戳是16{d8}。", "版本是4.{d1}.6。", "升级到 tool@3.2.{d1} 以后好了。", "从{d6}到{d6}之间。", "Order no. {o} never came. ", "The log says 16{d8} twice. ", "Pin it to tool@8.{d1}.6 for now. ",
    "We saw {d1} kinds of road last year. ", "They spent 12 days in court again. ", "About {d1} in a court. ", "Professor Ashgrove said so. ", "Kestrel Analytics published a chart. ", "Station Road Bakery changed its sign. ", "Maple Street is long. ",
    "老王和小李都不同意。", "王记面馆的招牌换了。", "梧桐路很长。", "秦淮路那一带我常去。", "薛岗街很长。", "@野生秦娥45 说得对。", "@安静雷鸥 说得对。", "谢邀。", "谢邀，不懂。", "高汤很好。", "方圆很大。", "Port Merrow is far. ", "Elmsford Partners Ltd hired many. ", "订单号{fake}查不到。", "快递单号{fake}。", "Order number {fake}. ", "Look up item 978-0-00-{d6} in a library. ", "Order no. {fake} never arrived. ", "单号{fake}，别弄丢。",
)


def common() -> str:
    """The characters that count as frequent in these documents."""
    fixed = "".join(FILLER_ZH) + "".join(b + a for b, _, a in POSITIVE) + COMMON_SURNAMES + "汤很好大路街" + USUAL + OTHER_COMMON + "".join(ORDINARY)
    return "".join(sorted({c for c in fixed if "一" <= c <= "鿿" and c not in GIVEN and c not in RARE_SURNAMES}))


def documents(count: int = 1200, seed: int = 20240611) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Texts with the (kind, start, end) of each item in them."""
    r = random.Random(seed)
    makers = {"phone": _phone, "email": _email, "idnum": _number, "zh_address": _zh_address, "en_address": _en_address, "zh_name": _zh_name, "en_name": _en_name}
    out = []
    for _ in range(count):
        text, truth, used = "", set(), {}
        for _ in range(r.randint(2, 6)):
            text += r.choice(FILLER_ZH if r.random() < 0.5 else FILLER_EN)
            if r.random() < 0.7:
                before, kind, after = r.choice(POSITIVE)
                value = used[kind] if kind in used and r.random() < 0.35 else makers[kind](r)
                used[kind] = value
                text += before
                truth.add((kind.split("_")[-1].replace("name", "person"), len(text), len(text) + len(value)))
                text += value + after
            else:
                text += r.choice(NEGATIVE).format(o=f"20{r.randint(10**15, 10**16 - 1)}", d6=f"{r.randint(0, 999999):06d}", d8=f"{r.randint(0, 10**8 - 1):08d}", d1=r.randint(2, 40), fake=f"20{r.randint(1000, 9999)}{_date(r)}{r.randint(0, 9999):04d}")
        out.append((text, truth))
    return out


def common_names(count: int = 1200, seed: int = 20240612) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Texts with names of common given characters, among words that begin or end with a family name."""
    from strataloom.llm.pii import FAMILY

    r = random.Random(seed)
    before_after = [(b, a) for b, kind, a in POSITIVE if kind == "zh_name"]
    out = []
    for _ in range(count):
        text, truth, used = "", set(), ""
        for _ in range(r.randint(2, 6)):
            if r.random() < 0.35:
                family = r.choice(TWO) if r.random() < 0.1 else r.choice(COMMON_SURNAMES + RARE_SURNAMES) if r.random() < 0.6 else r.choice(FAMILY)
                given = "".join(r.choice(USUAL if r.random() < 0.85 else OTHER_COMMON) for _ in range(r.choice((1, 2, 2, 2, 2, 2))))
                before, after = r.choice(before_after)
                used = used if used and r.random() < 0.35 else family + given
                text += before
                truth.add(("person", len(text), len(text) + len(used)))
                text += used + after
            else:
                text += "".join(r.choice(("", "", "", "", "和", "与", "我找", "感谢")) + r.choice(ORDINARY) for _ in range(r.randint(1, 5)))
        out.append((text, truth))
    return out
