"""Personal information in free text by a skip-chain conditional random field (problem 2)."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import chars
from strataloom.llm.quality import COMMON_EN, COMMON_ZH
from strataloom.llm.tables import written

LABELS = ("none", "email", "phone", "idnum", "address", "person")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID]", "address": "[ADDRESS]", "person": "[NAME]"}

# ---------------------------------------------------------------- fixed values
#: Chinese family names of one and of two characters.
FAMILY = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛范彭鲁韦昌马苗凤花方俞任袁柳鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐傅皮卞齐康伍余元卜顾孟平黄穆萧尹姚邵湛汪祁毛臧戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫裴陆翁荀詹乔温闫阎黎侯龙段武赖龚庄易覃佟"
)
FAMILY_TWO = ("欧阳", "司徒", "上官", "慕容", "钟离", "诸葛", "东方", "皇甫", "尉迟", "公孙", "令狐", "宇文", "长孙", "司马", "夏侯", "端木", "南宫", "独孤", "轩辕", "百里", "呼延", "申屠", "澹台", "闻人", "公冶", "太史", "濮阳", "淳于", "单于", "万俟")
#: Words that a capital starts without making them a part of a name.
OPENERS = frozenset(
    """ask regards parcel thanks nobody contact text write send call you they dear hi hello sincerely best yours cheers mr mrs ms miss dr prof
    professor sir madam doctor order look anything pin passport calling swapping keep whenever given without against since recently note
    also however though maybe yes no ok okay please sorry thank people everyone somebody anyone someone meet met from said says told tell
    love dedicated signed author editor by attn name names reply forward mail email phone tel mobile office line""".split()
)
TITLES = frozenset("mr mrs ms miss dr prof professor sir madam doctor captain".split())
STREETS = "road|street|lane|avenue|drive|court|row|way|close|crescent|square|place|terrace|hill|gardens|boulevard|parade|walk|mews|quay|gate|wharf|grove|green|yard|alley|circle|plaza|highway|rise|rd|st|ave|ln|dr|blvd|sq|ct|cres"
#: Last words of firms, shops, places and institutions.
FIRMS = frozenset(
    """road street lane avenue drive court row way close crescent square place terrace hill gardens boulevard bakery analytics ltd inc llc corp co company group
    holdings partners consulting solutions systems labs shop store cafe bar hotel inn school college university hospital clinic bank library museum park bridge
    station river lake mountain valley island vale port bay county city town village society club press media studio foundation institute association team""".split()
)
TOWN_HEADS = frozenset("port little great old new north south east west upper lower saint st mount lake fort".split())

_ASCII = "0-9A-Za-z"
_FULL = str.maketrans({chr(0xFF01 + k): chr(0x21 + k) for k in range(94) if chr(0x21 + k).isalnum() or chr(0x21 + k) in "@+"})
_FULL_ANY = re.compile("[０-９Ａ-Ｚａ-ｚ＠＋]")
_S = r"(?:\\?[-. –]|\\?-\\? )?"
_LEFT = rf"(?<![{_ASCII}_/=#@&%])(?<![{_ASCII}][.\-])(?<![{_ASCII}]\\[.\-])"
_RIGHT = rf"(?![{_ASCII}_@])(?!\\?[-.]\d)"
_DATE = r"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
_NUMBER = re.compile(
    _LEFT
    + "(?:"
    + "|".join(
        (
            rf"(?P<id18>[1-9]\d{{5}}{_S}(?:19|20)\d{{2}}{_S}{_DATE}{_S}\d{{3}}[\dXx])",
            rf"(?P<id15>[1-9]\d{{5}}{_S}\d{{2}}{_DATE}{_S}\d{{3}})",
            rf"(?P<mobile>(?:(?:\+|00|\(\\?\+)86\\?\)?{_S})?1[3-9]\d{_S}\d{{4}}{_S}\d{{4}})",
            rf"(?P<mobile3>(?:(?:\+|00|\(\\?\+)86\\?\)?{_S})?1[3-9]\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{2}})",
            rf"(?P<uk>(?:\+44\\?[ -]?(?:\(0\)\s?)?7\d{{3}}|0044[ -]?7\d{{3}}|07\d{{3}}|\(07\d{{3}}\\?\)){_S}\d{{3}}{_S}\d{{3}})",
            rf"(?P<us>(?:\+?1\\?[-. ]\s?)?(?:\(\d{{3}}\\?\)\s?|\d{{3}}\\?[-. ])\d{{3}}\\?[-. ]\d{{4}}(?:,?\s?(?:ext\\?\.?|x)\s?\d{{1,5}})?)",
            rf"(?P<zone>(?:(?:\+|00)86\\?[- ]?)?(?:\(0\d{{2,3}}\\?\)\s?|0\d{{2,3}}\\?[- ])\d{{7,8}})",
            rf"(?P<intl>\+\d{{1,3}}(?:\\?[-. ]?\(?\d{{1,5}}\)?){{2,5}})",
            r"(?P<ssn>\d{3}(?P<d>\\?[- ])\d{2}(?P=d)\d{4})",
            r"(?P<ni>[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])",
            r"(?P<passport>[A-Z]{2}\d{7}|[EGPDS]\d{8})",
        )
    )
    + ")"
    + _RIGHT
)
#: Every number has such a stretch.
_DIGITS = re.compile(r"\d[\d\-. ()\\–+]{4,}\d")
_ZH_DIGITS = "一二三四五六七八九零〇○幺两拐洞勾"
_SPELLED = re.compile(rf"(?<![{_ZH_DIGITS}0-9])(?:[{_ZH_DIGITS}0-9](?:[ \-])?){{10}}[{_ZH_DIGITS}0-9](?![{_ZH_DIGITS}0-9])")
_EN_DIGIT = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
_SPELLED_EN = re.compile(rf"\b(?:(?:plus|double|triple|{_EN_DIGIT})[\s,-]+){{6,}}(?:{_EN_DIGIT})\b", re.I)
_EMAIL = re.compile(
    rf"(?<![{_ASCII}_.+\\-])(?P<local>[{_ASCII}](?:\\?[{_ASCII}_.+%-])*)"
    r"(?P<at>\\?\s?@\s?|\s?\\?[\(\[\{（【]\s?(?:at|AT|@|艾特)\s?\\?[\)\]\}）】]\s?|\s(?:at|AT|At)\s|\s?&(?:#64|#[xX]40|commat);\s?|%40|\\?#|\s艾特\s|艾特)"
    rf"(?P<domain>[{_ASCII}](?:\\?[{_ASCII}-])*"
    rf"(?:(?:\s?\\?\.\s?|\s(?:dot|DOT|Dot)\s|\s?\\?[\(\[\{{（【]\s?(?:dot|DOT|\.|点)\s?\\?[\)\]\}}）】]\s?|\s?点\s?)[{_ASCII}](?:\\?[{_ASCII}-])*)+)"
)
_MAIL_HINT = re.compile(r"[@#＠]|%40|&commat|艾特|(?<![A-Za-z])at(?![A-Za-z])", re.I)
_TLD = re.compile(r"[A-Za-z]{2,}$")
_ROAD = re.compile(
    r"(?:大道|[路街道巷弄]|胡同|里弄)\s?(?P<no>[0-9]{1,5}|[一二三四五六七八九十百零〇]{1,5})\s?(?:号|號|弄\d+号)"
)
_ZH_PLACE = re.compile(
    r"(?:(?:中国)?\s?[一-鿿]{2,4}?(?:省|自治区|特别行政区)[ ，,]?)?(?:[一-鿿]{1,5}?(?:市|自治州|地区|盟|州)[ ，,]?)?(?:[一-鿿]{1,5}?(?:新区|区|县|旗|市)[ ，,]?)?"
    r"(?:[一-鿿]{1,4}?(?:镇|乡|街道)[ ，,]?)?(?P<road>[一-鿿]{1,4}?(?:[东西南北中]|上|下)?(?:大道|[路街道巷弄]|胡同|里弄))$"
)
_ZH_EDGE = re.compile(r"[在到住往至于址从是去寄送给：:]$|(?:搬来|位于|坐落|[^一-鿿])$")
_EN_ADDRESS = re.compile(
    rf"(?<![{_ASCII}_/=#.\-])(?:(?:flat|apt|apartment|unit|suite|room|floor)\\?\.?\s\\?#?[0-9A-Za-z]{{1,4}},?\s)?\d{{1,5}}[A-Za-z]?,?\s(?:[A-Za-z][A-Za-z’'\-]*\\?\.?\s){{1,3}}?(?:{STREETS})\b(?!\s(?:trip|bakery))"
    r"(?:\\?\.?,\s(?:apt|flat|unit|suite|apartment|room)\\?\.?\s\\?#?[0-9A-Za-z]{1,4})?(?-i:,\s(?:[A-Z][a-z]+)(?:\s[A-Z][a-z]+)?)?(?-i:,?\s(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}|[A-Z]{2}\s\d{5}|\d{5}))?",
    re.I,
)
_MENTION = re.compile(r"@\S{0,8}$")
#: Every English address has such a start.
_HOUSE = re.compile(r"\d[A-Za-z]?,?\s[A-Za-z]")
_CAPITAL = r"(?:[A-Z][a-z]+(?:[’'\-][A-Z]?[a-z]+)*|[A-Z]{2,}(?:[’'\-][A-Z]{2,})?)"
_RUN = re.compile(rf"(?<![{_ASCII}_@#/.\-]){_CAPITAL}(?:\\?\.)?(?:,?\s(?:{_CAPITAL}\b|[A-Z]\\?\.?(?=[\s,])))+(?![{_ASCII}_@/=])")
_LABELS_LEFT = (
    ("phone", re.compile(r"(?:电话|手机|微信(?:同号)?|致电|直接|可以打|拨打|号码|联系|加我|phone|call|text me|tel|mobile|whatsapp|reach .{0,30} on|line|ring|fax)[^一-鿿A-Za-z0-9]{0,6}(?:at |on |me )?[^A-Za-z0-9]{0,3}$", re.I)),
    ("idnum", re.compile(r"(?:身份证(?:号码?)?|证件号?(?:码)?(?:是)?|护照号?|社保号?|保险号?|passport|insurance number|id card|ssn|social security|national insurance|no)[^一-鿿A-Za-z0-9]{0,4}(?:no\.? |number )?$", re.I)),
    ("mail", re.compile(r"(?:邮箱|邮件到?|写信给|联系方式|找|mail|inbox is|contact|write to|reach .{0,20} at)\W{0,4}$", re.I)),
    ("person", re.compile(r"(?:收件人|联系人|姓名\W?|署名\W?|落款\W?|跟|找|和|与|thanks to|ask|dr\\?\.|told|reach|name is|regards,|and|for|dear|mr\\?\.|ms\\?\.|mrs\\?\.|my name,|by)\s?$", re.I)),
    ("place", re.compile(r"(?:地址\W?|寄到|住|住在|在|到|live at|send it to|deliver to|at|to)\s?$", re.I)),
    ("against", re.compile(r"(?:订单号?|单号|书号|时间戳(?:是)?|版本(?:是)?|编号|快递|isbn|order(?: no\\?\.?| number)?|item|release|version|between|invoice|tracking|sku|从)\W{0,3}$", re.I)),
)
_TAIL_NAME = re.compile(r"^(?:收|手里|说|写|先生|女士|老师|同学|教授|医生|律师|[，。、；：！？）（」「【】《,.!?;:()\[\s<\n—]|在|还是|当时|见过|建议|这件事|一直|居然|其实|后悔|的|和|与|把|被|对|给|让|没|总|也|都|又|周末|上个月|去年|今年|昨天|今天|前天|那天|后来|$)")
_PLACE_NAME = re.compile(r"[一-鿿]{2,3}(?:路|街|巷|大道|弄|区|市|省|县|镇|村|山|湖|河|桥|寺|楼|店|馆|邀)|谢邀")
_TAIL_VERB = re.compile(r"^(?:[’']s)?[\s,.()\[\]\\]*(?:[a-z]+(?:ed|s|ly)?\b|$|[,.!?)\]<\n])")
_BREAK = re.compile(r"[。！？!?\n]|<(?:/?p|br|/?li|/?div|/?h\d|/?blockquote)\b|(?<=[a-z])\.\s")


#: Characters often met in given names, and characters that mostly are function words; both are features only.
USUAL_GIVEN = frozenset(
    "国强建军明伟志海天小雨文华杰峰磊静丽敏娟涛超鹏辉刚勇平红玉兰英秀芳春梅晓东林波斌宇浩然子轩欣怡佳思梦洁雪云龙飞亮光荣成德永福祥新中立宏大学家庆生正安宁清美玲霞燕琴艳莉晨阳凯俊豪威武利民心月星河山川青松柏竹若如诗书墨言婉晴岚"
)
FUNCTION_HAN = frozenset("的一是不了在有我他她它这个们来上和地到以说时要就出会可也你对能而那得于着下之过发后里用么去都同现当没动面起看还些其把被让给再先换更最很则虽即将已曾每几两何谁哪怎什且或者与及但因只从想比等很并至否未")
#: Characters that begin a common verb or adverb after a name of one given character.
_VERB_HEADS = frozenset("当见建一居其后这在和与的还把就果仍总反难简几偶往通恐未渐大多确")


@dataclass
class Candidate:
    start: int
    end: int
    label: str
    shape: str
    key: str
    features: list[str] = field(default_factory=list)


def _checksum(digits: str) -> bool:
    """The public check character of 18-digit identity numbers (ISO 7064, MOD 11-2)."""
    weights = [2 ** (17 - k) % 11 for k in range(17)]
    return "10X98765432"[sum(int(d) * w for d, w in zip(digits[:17], weights)) % 11] == digits[17].upper()


class Finder:
    """Candidate items of a text. Every family name before a Han character is one; ``common``, the frequent characters
    of the corpus, and ``words``, pairs with a family name in many of its texts, only tell features of it."""

    def __init__(self, common: str, words: frozenset[str] = frozenset()) -> None:
        two = "|".join(FAMILY_TWO)
        self.banned, self.words = frozenset(common), words
        self.two, self.family = frozenset(FAMILY_TWO), frozenset(FAMILY)
        # the characters a family name begins with, before a Han character: one class, as alternatives would be tried at every place
        self.head = re.compile(rf"[{FAMILY}{''.join(sorted({t[0] for t in FAMILY_TWO}))}](?=[一-鿿])")
        self.labels = ("收件人", "联系人", "收货人", "姓名", "署名", "落款", "户名", "我叫", "名叫", "收款人")
        self.strong = re.compile(rf"(?:收件人|联系人|收货人|(?:姓名|署名|落款|户名)\s?[：:]\s?|我叫|名叫|收款人|户名\s?[：:]\s?)(?P<name>(?:{two}|[{FAMILY}])[一-鿿]{{1,2}})(?![一-鿿]{{2}}(?:公司|店|馆))")

    def __call__(self, raw: str) -> list[Candidate]:
        text = raw.translate(_FULL) if _FULL_ANY.search(raw) else raw
        found: list[Candidate] = []
        add = found.append
        if _MAIL_HINT.search(text):
            for m in _EMAIL.finditer(text):
                domain, at = m["domain"].replace("\\", ""), m["at"]
                worded = not any(c in at for c in "@#([{（【艾&%")
                if "&" in at or "%" in at:
                    at = "@"
                tld = re.split(r"[^A-Za-z0-9\-]+", domain)
                tld = [x for x in tld if x.lower() != "dot"]
                spelled = bool(re.search(r"dot|点", domain, re.I))
                if len(tld) < 2 or not _TLD.search(tld[-1]) or any(x.isdigit() for x in tld[-1]) or (worded and not spelled):
                    continue
                if "#" in at and (m["local"].lower() in ("c", "f") or tld[-1].lower() in ("html", "htm", "php", "js", "py", "md")):
                    continue
                shape = "email_word" if worded else "email_hash" if "#" in at else "email"
                add(Candidate(m.start(), m.end(), "email", shape, (m["local"] + "@" + ".".join(tld)).replace("\\", "").lower()))
        for m in _NUMBER.finditer(text) if _DIGITS.search(text) else ():
            shape = m.lastgroup if m.lastgroup != "d" else "ssn"
            digits = re.sub(r"[^0-9A-Za-z]", "", m.group())
            label = "idnum" if shape in ("id18", "id15", "ssn", "ni", "passport") else "phone"
            c = Candidate(m.start(), m.end(), label, shape, digits)
            if shape == "id18":
                c.features.append("check_ok" if _checksum(digits) else "check_bad")
            add(c)
        for pattern, shape in ((_SPELLED, "spelled"), (_SPELLED_EN, "spelled_en")):
            for m in pattern.finditer(text):
                value = m.group()
                if shape == "spelled" and (value.strip().isdigit() or not re.match(r"[一幺10零〇洞]", value) or len(re.findall(r"[0-9]", value)) > 8):
                    continue
                add(Candidate(m.start(), m.end(), "phone", shape, re.sub(r"[\s-]", "", value)))
        if "号" in text or "號" in text:
            for m in _ROAD.finditer(text):
                low = max(0, m.start() - 26)
                head = text[low : m.end() - len(m.group()) + len(re.match(r"大道|[路街道巷弄]|胡同|里弄", m.group()).group())]
                start = self._left(head)
                if start is not None:
                    add(Candidate(low + start, m.end(), "address", "zh_address", re.sub(r"\s", "", text[low + start : m.end()])))
        covered: list[tuple[int, int]] = []
        for m in _EN_ADDRESS.finditer(text) if _HOUSE.search(text) else ():
            words = re.findall(r"[A-Za-z]+", re.sub(r"^.*?\d+[A-Za-z]?,?\s", "", m.group().split(",")[0] if m.group()[0].isdigit() else m.group().split(",")[1] if "," in m.group() else m.group(), count=1))
            c = Candidate(m.start(), m.end(), "address", "en_address", re.sub(r"\W+", " ", m.group().lower()))
            c.features.append("filler" if any(w.lower() in COMMON_EN or w.lower() in ("kinds", "years", "days", "times", "people", "hours", "minutes", "cases", "weeks", "months", "percent") for w in words[:-1]) else "plain_words")
            add(c)
            covered.append((m.start(), m.end()))
        for m in _RUN.finditer(text):
            if any(a <= m.start() < b for a, b in covered):
                continue
            self._english(text, m, found)
        labelled = {m.start("name") for m in self.strong.finditer(text)} if any(x in text for x in self.labels) else ()
        rare: list[tuple[int, int]] = []
        for start, given in self._families(text):
            usual = text[given] in self.banned and start not in labelled
            shared = [] if usual else self._traits(text, start, given, rare)
            for end in (given + 1, given + 2):
                if end > given + 1 and not "一" <= text[end - 1 : end] <= "鿿":
                    break
                c = Candidate(start, end, "person", "zh_common" if usual else "zh_name", text[start:end])
                c.features = self._usual(text, start, given, end) if usual else [*shared, *self._ending(text, given, end)]
                if start in labelled:
                    c.features.append("zh_labelled")
                add(c)
        return self._finish(text, found)

    def _families(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, start of the given name) of every family name before a Han character; 谢邀 (thanks for asking) is a set phrase."""
        low = 0
        for m in self.head.finditer(text):
            start = m.start()
            if start < low:
                continue
            if text[start : start + 2] in self.two and "一" <= text[start + 2 : start + 3] <= "鿿":
                low = start + 2
                yield start, low
            elif text[start] in self.family and text[start : start + 2] != "谢邀":
                yield start, start + 1

    def _traits(self, text: str, start: int, given: int, rare: list[tuple[int, int]]) -> list[str]:
        """What does not depend on where a name ends; ``rare`` holds the names begun so far with an uncommon family name."""
        traits = ["two_family" if given - start == 2 else "one_family"]
        traits.append("family_common" if text[given - 1] in self.banned and given - start == 1 else "family_rare")
        after = given + 2 if text[given : given + 2] in self.two else given + 1 if text[given] in self.family else 0
        if after and "一" <= text[after : after + 1] <= "鿿" and text[after] not in self.banned:
            traits.append("inner_common" if traits[-1] == "family_common" else "inner_rare")
        if rare and rare[-1][1] > start:
            traits.append("inside_family_rare")
        if traits[1] == "family_rare":
            rare.append((start, given + 1))
        return traits

    def _ending(self, text: str, given: int, end: int) -> list[str]:
        """What tells whether a name ends at ``end``."""
        tail = bool(_TAIL_NAME.match(text[end : end + 6]))
        size = end - given
        traits = [f"given{size}", "tail" if tail else "no_tail", f"given{size}&{'tail' if tail else 'no_tail'}"]
        if size == 2:
            second = text[end - 1]
            common = second in self.banned
            traits.append("second_common" if common else "second_rare")
            if common and second in _VERB_HEADS:
                traits.append("second_verb")
            if common and _TAIL_NAME.match(text[end - 1 : end + 5]):
                traits.append("second_tail")
        return traits

    def _usual(self, text: str, start: int, given: int, end: int) -> list[str]:
        """Features of a name whose given name begins with a common character; they have weights of their own."""
        traits = ["two_family" if given - start == 2 else "one_family"]
        traits.append(f"usual{sum(x in USUAL_GIVEN for x in text[given:end])}of{end - given}")
        if any(x in FUNCTION_HAN and x not in USUAL_GIVEN for x in text[given:end]):
            traits.append("function")
        if text[given - 1 : given + 1] in self.words:
            traits.append("word")
        left = text[start - 1 : start] if start else ""
        if left + text[start] in self.words or left + text[start] in ("感谢", "多谢", "谢谢", "答谢"):
            traits.append("left_word")
        if any(text[k : k + 2] in self.words for k in range(given, end)):
            traits.append("right_word")
        if end - given == 2 and text[end - 1] in _VERB_HEADS:
            traits.append("second_verb")
        free = "known" if len(traits) > 2 else "free"
        traits.append("han_left" if "一" <= left <= "鿿" else "edge_left")
        traits.append("tail" if _TAIL_NAME.match(text[end : end + 6]) or text[end : end + 1] in tuple("也又却") else "no_tail")
        traits += [f"{free}&{traits[1]}", f"{free}&{traits[1]}&{traits[-2]}&{traits[-1]}"]
        return traits

    @staticmethod
    def _left(head: str) -> int | None:
        """Where the address begins in the text up to the end of the road's name."""
        best, least = None, 0
        for m in re.finditer(r"[在到住往至于址寄搬]", head):
            least = m.end()
        for k in range(len(head) - 2, least - 1, -1):
            if not "一" <= head[k] <= "鿿":
                continue
            before = head[:k]
            if before and not _ZH_EDGE.search(before):
                continue
            if _ZH_PLACE.match(head[k:]):
                best = k
        return best

    @staticmethod
    def _english(text: str, m: re.Match, found: list[Candidate]) -> None:
        tokens = [(t.start() + m.start(), t.group()) for t in re.finditer(rf"{_CAPITAL}\b|[A-Z](?=\\?\.|[\s,])", m.group())]
        title = False
        while tokens and (tokens[0][1].lower() in OPENERS or tokens[0][1].lower() in COMMON_EN):
            title = tokens[0][1].lower() in TITLES
            tokens = tokens[1:]
        words = [t for t in tokens if len(t[1]) > 1]
        if len(words) < 2 or len(tokens[0][1]) == 1:
            return
        # a comma parts two names unless it joins family and given name
        span = text[tokens[0][0] : m.end()]
        while len(words) > 2 and "," in span:
            first = span.split(",")[0]
            if len(re.findall(_CAPITAL, first)) >= 2:
                cut = tokens[0][0] + len(first)
                tokens = [t for t in tokens if t[0] < cut]
            else:
                second = tokens[0][0] + len(",".join(span.split(",")[:2]))
                tokens = [t for t in tokens if t[0] < second]
            words = [t for t in tokens if len(t[1]) > 1]
            break
        if len(words) < 2:
            return
        end = tokens[-1][0] + len(tokens[-1][1])
        last = words[-1][1].lower()
        c = Candidate(tokens[0][0], end, "person", "en_name", " ".join(w.lower() for _, w in words))
        c.features.append("firm" if last in FIRMS or any(w.lower() in FIRMS for _, w in words[1:]) else "no_firm")
        if words[0][1].lower() in TOWN_HEADS:
            c.features.append("town")
        if title:
            c.features.append("title")
        if len(tokens) > len(words):
            c.features.append("initial")
        if "," in text[c.start : end]:
            c.features.append("comma")
        c.features.append(f"words{min(4, len(words))}")
        if all(w.isupper() for _, w in words):
            c.features.append("upper" if max(len(w) for _, w in words) > 3 else "short_upper")
        if any(w.lower() in COMMON_EN for _, w in words):
            c.features.append("common_inside")
        found.append(c)

    @staticmethod
    def _finish(text: str, found: list[Candidate]) -> list[Candidate]:
        order = {"email": 0, "email_hash": 0, "email_word": 0, "zh_address": 1, "en_address": 1}
        found.sort(key=lambda c: (order.get(c.shape, 2), c.start, -c.end))
        kept: list[Candidate] = []
        first: dict[tuple[int, str], Candidate] = {}
        block: dict[int, list[Candidate]] = {}  # the kept items that touch each stretch of 64 characters
        for c in found:
            touched = range(c.start >> 6, (max(c.end, c.start + 1) - 1 >> 6) + 1)
            if any(c.start < k.end and k.start < c.end and not (k.label == c.label == "person") for b in touched for k in block.get(b, ())):
                same = first.get((c.start, c.label))
                if same:
                    same.features.append(c.shape)
                continue
            kept.append(c)
            first.setdefault((c.start, c.label), c)
            for b in touched:
                block.setdefault(b, []).append(c)
        kept.sort(key=lambda c: (c.start, c.end))
        around: dict[int, list[str]] = {}
        for c in kept:
            left, right = text[max(0, c.start - 40) : c.start], text[c.end : c.end + 20]
            c.features.append(f"shape={c.shape}")
            if (before := around.get(c.start)) is None:
                before = around[c.start] = [f"left={name}" for name, pattern in _LABELS_LEFT if pattern.search(left)]
            c.features += before
            if c.shape == "zh_common":
                c.features = [f if f.startswith("common:") else f"common:{f}" for f in c.features]
                if _PLACE_NAME.match(text[c.start : c.start + 6]):
                    c.features.append("common:place")
                if "@" in left and _MENTION.search(left):
                    c.features.append("common:mention")
                c.features.append("common:bias")
                continue
            if c.label == "person":
                if c.shape.startswith("zh"):
                    c.features.append("han_left" if left[-1:] and "一" <= left[-1] <= "鿿" else "edge_left")
                    if re.match(r"[一-鿿]?记", text[c.start + 1 : c.start + 3]) or re.match(r"[一-鿿]{0,2}(?:公司|面馆|酒楼|商店|书店|药房|集团)", text[c.start + 2 : c.start + 7]):
                        c.features.append("shop")
                    if re.search(r"[老小阿]$", left):
                        c.features.append("nick")
                else:
                    c.features.append("tail" if _TAIL_VERB.match(right) else "no_tail")
                if "@" in left and _MENTION.search(left):
                    c.features.append("mention")
                if _PLACE_NAME.match(text[c.start : c.start + 6]):
                    c.features.append("place")
            if re.search(r"[（(\[【—]\\?$|- \\?$", left):
                c.features.append("bracket")
            c.features.append("bias")
        return kept


# ---------------------------------------------------------------- the field


#: Readings that overlap exclude each other; messages are mixed with the ones before.
EXCLUDE, DAMPING, NEAR = -8.0, 0.5, 40
LABEL = {name: k for k, name in enumerate(LABELS)}


class Graph:
    """The readings of many texts as nodes, and the factors between them as arrays.

    A node is a place where an item of one kind may begin; its states are "nothing" and each reading (each end) of the
    item. Factors: neighbours within NEAR characters by their labels (chain), readings of the same or a similar
    surface, however distant, linked each to the one before (skip: ``same``, and ``part`` for a shared part of an English
    name), and readings that overlap (exclude). No factor joins two texts.
    """

    STATES = 3

    def __init__(self, texts: list[list[Candidate]]) -> None:
        self.node, self.state, labels = [], [], []
        one, two, kind, spot = [], [], [], []
        for items in texts:
            last: dict[tuple[str, str, str], tuple[int, int]] = {}
            first = len(labels)
            ends: list[int] = []
            before: Candidate | None = None
            for c in items:
                if before is not None and (before.start, before.label) == (c.start, c.label) and self.state[-1] + 1 < self.STATES:
                    self.state.append(self.state[-1] + 1)
                    ends[-1] = max(ends[-1], c.end)
                else:
                    labels.append(LABEL[c.label])
                    self.state.append(1)
                    if before is not None and c.start - before.end <= NEAR:
                        one.append(len(labels) - 2)
                        two.append(len(labels) - 1)
                        kind.append(0)
                        spot.append((0, 0))
                    ends.append(c.end)
                node, state = len(labels) - 1, self.state[-1]
                self.node.append(node)
                before = c
                keys = [("same", c.label, c.key)]
                if c.shape == "en_name":
                    keys += [("part", c.label, w) for w in c.key.split()]
                linked = set()
                for key in keys:
                    if key in last and last[key][0] != node and last[key][0] not in linked:
                        one.append(last[key][0])
                        two.append(node)
                        kind.append(1 if key[0] == "same" else 2)
                        spot.append((last[key][1], state))
                        linked.add(last[key][0])
                    last[key] = (node, state)
            starts: dict[int, list[tuple[int, int, int]]] = {}
            for node, state, c in zip(self.node[-len(items) :] if items else (), self.state[-len(items) :] if items else (), items):
                starts.setdefault(node, []).append((c.start, c.end, state))
            for node in range(first, len(labels)):
                follow = node + 1
                while follow < len(labels) and starts[follow][0][0] < ends[node - first]:
                    for _, end, a in starts[node]:
                        for start, _, b in starts[follow]:
                            if end > start:
                                one.append(node)
                                two.append(follow)
                                kind.append(3)
                                spot.append((a, b))
                    follow += 1
        self.labels = np.array(labels, dtype=np.int64)
        self.node, self.state = np.array(self.node, dtype=np.int64), np.array(self.state, dtype=np.int64)
        self.one, self.two, self.kind = (np.array(x, dtype=np.int64) for x in (one, two, kind))
        self.spot = np.array(spot, dtype=np.int64).reshape(-1, 2)
        # where a pair of states takes its weight: a pair of labels, linked readings that are both, or only one of them, chosen
        n, width = len(labels), len(LABELS)
        seen = np.where(np.arange(self.STATES) > 0, self.labels[:, None], 0) if n else np.zeros((0, self.STATES), np.int64)
        self.slot = seen[self.one][:, :, None] * width + seen[self.two][:, None, :] if len(self.one) else np.zeros((0, 3, 3), np.int64)
        far = self.kind > 0
        a = np.arange(self.STATES)[None, :, None] == self.spot[:, 0][:, None, None]
        b = np.arange(self.STATES)[None, None, :] == self.spot[:, 1][:, None, None]
        base = width * width
        link = np.where(a & b, base + 2 * self.kind[:, None, None] - 2, np.where(a | b, base + 2 * self.kind[:, None, None] - 1, base + 4))
        self.slot = np.where(far[:, None, None] & (self.kind < 3)[:, None, None], link, self.slot)
        self.slot = np.where((self.kind == 3)[:, None, None], np.where(a & b, base + 5, base + 4), self.slot)

    #: Pair weights: 36 of labels, both and one of "same", both and one of "part", none, and the fixed exclusion.
    PAIRS = len(LABELS) ** 2 + 6


class Field:
    """Weights per (label, feature) of a reading, and of pairs of states; skip weights may be switched off to see what they do."""

    def __init__(self, unary: dict[tuple[str, str], float], pairs: np.ndarray) -> None:
        self.unary, self.pairs = unary, pairs

    def without_skip(self) -> Field:
        pairs = self.pairs.copy()
        pairs[len(LABELS) ** 2 : len(LABELS) ** 2 + 4] = 0.0
        return Field(self.unary, pairs)

    def score(self, c: Candidate) -> float:
        get, label = self.unary.get, c.label
        return sum(get((label, f), 0.0) for f in c.features)

    def marginals_of(self, texts: list[list[Candidate]], rounds: int = 12) -> np.ndarray:
        """The probability of each reading, in order, by loopy sum-product messages over all its text."""
        graph = Graph(texts)
        own = np.full((len(graph.labels), Graph.STATES), -1e9)
        own[:, 0] = 0.0
        own[graph.node, graph.state] = [self.score(c) for items in texts for c in items]
        belief, _ = _messages(graph, own, self.pairs, rounds)
        return np.exp(belief)[graph.node, graph.state]

    def marginals(self, items: list[Candidate], rounds: int = 12) -> np.ndarray:
        return self.marginals_of([items], rounds)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _messages(graph: Graph, own: np.ndarray, pairs: np.ndarray, rounds: int, want_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Log marginals of the nodes, and if wanted of the factors, after damped loopy message passing."""
    joint = None
    total = own
    if len(graph.one):
        table = pairs[graph.slot]
        send, take = np.r_[graph.one, graph.two], np.r_[graph.two, graph.one]
        both = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(table), 2 * len(table)), np.arange(len(table))]
        message = np.zeros((len(send), Graph.STATES))

        def gathered(message: np.ndarray) -> np.ndarray:
            return own + np.stack([np.bincount(take, weights=message[:, k], minlength=len(own)) for k in range(Graph.STATES)], axis=1)

        for _ in range(rounds):
            going = (gathered(message)[send] - message[back])[:, :, None] + both
            new = going.max(axis=1)
            new += np.log(np.exp(going - new[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        total = gathered(message)
        if want_pairs:
            n = len(table)
            joint = (total[graph.one] - message[n:])[:, :, None] + (total[graph.two] - message[:n])[:, None, :] + table
            joint -= _log_sum(joint.reshape(n, -1), 1)[:, None, None]
    return total - _log_sum(total, 1)[:, None], joint


def fit(finder: Finder, documents: list[tuple[str, set[tuple[str, int, int]]]], rounds: int = 60) -> Field:
    """Joint training: the gradient of the likelihood of the labelled readings, expectations by loopy messages.

    All weights, those of features and those of chain and skip factors, are fitted together. A node whose item is true has
    the reading of the true end, or the first one if none ends there.
    """
    texts, gold = [], []
    for text, truth in documents:
        items = finder(text)
        texts.append(items)
        ends = {(kind, a): b for kind, a, b in truth}
        gold += [2 if ends.get((c.label, c.start)) == c.end else int((c.label, c.start) in ends) for c in items]
    graph = Graph(texts)
    every = [c for items in texts for c in items]
    state = np.zeros(len(graph.labels), dtype=np.int64)
    for level in (1, 2):  # exact ends override others
        for k in np.flatnonzero(np.array(gold) == level)[::-1]:
            state[graph.node[k]] = graph.state[k]
    names = sorted({(c.label, f) for c in every for f in c.features})
    place = {n: k for k, n in enumerate(names)}
    reading = np.repeat(np.arange(len(every)), [len(c.features) for c in every])
    feature = np.array([place[c.label, f] for c in every for f in c.features], dtype=np.int64)
    chosen = (state[graph.node] == graph.state).astype(float)
    w, v = np.zeros(len(names)), np.zeros(Graph.PAIRS)
    v[-1] = EXCLUDE
    seen = np.bincount(graph.slot[np.arange(len(graph.one)), state[graph.one], state[graph.two]], minlength=Graph.PAIRS)
    scale_w, scale_v = np.full(len(w), 1e-6), np.full(len(v), 1e-6)
    for _ in range(rounds):
        own = np.full((len(graph.labels), Graph.STATES), -1e9)
        own[:, 0] = 0.0
        own[graph.node, graph.state] = np.bincount(reading, weights=w[feature], minlength=len(every))
        belief, joint = _messages(graph, own, v, 4, True)
        p = np.exp(belief)[graph.node, graph.state]
        step = np.bincount(feature, weights=(chosen - p)[reading], minlength=len(w)) - 0.5 * w
        expected = np.bincount(graph.slot.ravel(), weights=np.exp(joint).ravel(), minlength=Graph.PAIRS)
        pull = seen - expected - 2.0 * v
        pull[-2:] = 0.0
        scale_w, scale_v = scale_w + step**2, scale_v + pull**2
        w += 0.5 * step / np.sqrt(scale_w)
        v += 0.2 * pull / np.sqrt(scale_v)
    return Field({n: float(w[k]) for n, k in place.items()}, v)


# ---------------------------------------------------------------- operator

#: A character is common if it makes up more than this share of all Han characters of the corpus.
COMMON_SHARE = 6e-5
THRESHOLD = 0.5


#: A pair with a family name is a word if more than this share of the distinct texts, and more than 20, have it.
WORD_SHARE = 5e-4
_HAN, _SPAN = 0x4E00, 0x5200


def _count_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each Han character (``c`` under _SPAN), and the texts with each pair of which one is a family name."""
    total = np.zeros(_SPAN, dtype=np.int64)
    family = np.zeros(_SPAN, dtype=bool)
    family[[ord(c) - _HAN for c in FAMILY + "".join(FAMILY_TWO)]] = True
    pairs, counts, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        size += len(texts)
        for low, high in chars.slices(np.array([len(t) for t in texts])):
            codes = chars.flat(chars.join(texts[low:high])).astype(np.int64)
            row = np.cumsum(codes == 0)
            codes -= _HAN
            han = (codes >= 0) & (codes < _SPAN)
            total += np.bincount(codes[han], minlength=_SPAN)
            at = np.flatnonzero(han[:-1] & han[1:])
            at = at[family[codes[at]] | family[codes[at + 1]]]
            pair = codes[at] * _SPAN + codes[at + 1] + _SPAN
            seen, n = np.unique(np.unique(row[at] << 32 | pair) & 0xFFFFFFFF, return_counts=True)
            pairs, back = np.unique(np.r_[pairs, seen], return_inverse=True)
            counts = np.bincount(back, weights=np.r_[counts, n], minlength=len(pairs)).astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some, pairs].astype(np.int64)), pa.array(np.r_[size, total[some], counts])], names=["c", "n"])


@dataclass(frozen=True)
class Commonness:
    """Frequent characters, and pairs with a family name that are in many texts."""

    characters: str
    words: frozenset[str]


def commonness(texts: DataFrame) -> Commonness:
    """The Han characters of more than COMMON_SHARE of all Han characters and the words with a family name.

    Every distinct text counts once, so copies and recaptures make nothing common. At most 20,992 counts of characters
    reach the driver, and the pairs of more than WORD_SHARE of the texts.
    """
    counted = written(texts.dropDuplicates().mapInArrow(_count_chars, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")), "commonness")
    counts = counted.where(F.col("c") < _SPAN).collect()
    size = sum(r.n for r in counts if r.c < 0)
    counts = [r for r in counts if r.c >= 0]
    total = sum(r.n for r in counts)
    frequent = {chr(_HAN + r.c) for r in counts if r.n > max(COMMON_SHARE * total, 20)}
    pairs = counted.where((F.col("c") >= _SPAN) & (F.col("n") > max(WORD_SHARE * size, 20))).collect()
    words = frozenset(chr(_HAN + (r.c - _SPAN) // _SPAN) + chr(_HAN + (r.c - _SPAN) % _SPAN) for r in pairs)
    return Commonness("".join(sorted(frequent | set(COMMON_ZH))), words)


def common_characters(texts: DataFrame) -> str:
    """The characters of ``commonness``."""
    return commonness(texts).characters


@functools.cache
def trained() -> Field:
    """The field's weights, fitted once in the driver on documents made from patterns."""
    from strataloom.llm import pii_samples

    return fit(Finder(pii_samples.common(), pii_samples.WORDS), pii_samples.documents(1000) + pii_samples.common_names(1000))


@functools.lru_cache(maxsize=4)
def _finder(common: str | Commonness) -> Finder:
    from strataloom.llm import pii_samples

    known = common if isinstance(common, Commonness) else Commonness(common, pii_samples.WORDS)  # words that were not counted
    return Finder(known.characters, known.words)


def find_in(text: str, common: str | Commonness = "", threshold: float = THRESHOLD, field: Field | None = None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, probability) of each item of one text, in code points."""
    return find_each([text], common, threshold, field)[0]


def find_each(texts: list[str], common: str | Commonness = "", threshold: float = THRESHOLD, field: Field | None = None) -> list[list[tuple[str, int, int, float]]]:
    """``find_in`` of every text; the messages of up to 256 texts go in the same arrays."""
    finder, model = _finder(common), field or trained()
    out = []
    for low in range(0, len(texts), 256):
        items = [finder(t) for t in texts[low : low + 256]]
        sure = iter(model.marginals_of(items).tolist() if any(items) else ())
        out += [_chosen([(c, next(sure)) for c in row], threshold) for row in items]
    return out


def _chosen(items: list[tuple[Candidate, float]], threshold: float) -> list[tuple[str, int, int, float]]:
    """At each place the likeliest reading, if something begins there with at least the threshold; of two that overlap the likelier."""
    places: dict[tuple[int, str], list[tuple[Candidate, float]]] = {}
    for c, p in items:
        places.setdefault((c.start, c.label), []).append((c, p))
    best = [(max(r, key=lambda x: x[1])[0], sum(p for _, p in r)) for r in places.values()]
    out: list[tuple[Candidate, float]] = []
    k = 0
    while k < len(best):
        # places whose likeliest readings overlap share one decision: whether any of them holds, and then the likeliest
        group, end = [best[k]], best[k][0].end
        while k + len(group) < len(best) and best[k + len(group)][0].start < end:
            end = max(end, best[k + len(group)][0].end)
            group.append(best[k + len(group)])
        k += len(group)
        while group:
            c, p = max(group, key=lambda x: x[1])
            beside = sum(q for d, q in group if d.start < c.end and c.start < d.end)
            if beside < threshold:
                break
            out.append((c, p))
            group = [(d, q) for d, q in group if d.start >= c.end or d.end <= c.start]
    out.sort(key=lambda x: x[0].start)
    return [(c.label, c.start, c.end, p) for c, p in out]


def replaced(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with every found item replaced by the placeholder of its kind, everything else unchanged."""
    out, last = [], 0
    for kind, start, end, _ in sorted(found, key=lambda x: x[1]):
        if start < last:
            continue
        out += [text[last:start], PLACEHOLDER[kind]]
        last = end
    return "".join(out) + text[last:]


def _scan(common: str | Commonness, carried: int, with_text: bool):
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(carried).to_pylist()
            row, kind, start, end, clean = [], [], [], [], []
            for k, (text, found) in enumerate(zip(texts, find_each(texts, common, THRESHOLD, field))):
                if with_text:
                    row.append(k)
                    clean.append(replaced(text, found))
                    kind.append([f[0] for f in found])
                else:
                    for what, a, b, _ in found:
                        row.append(k)
                        kind.append(what)
                        start.append(a)
                        end.append(b)
            keys = [batch.column(c).take(pa.array(row, pa.int64())) for c in range(carried)]
            if with_text:
                values = [pa.array(clean, pa.string()), pa.array(kind, pa.list_(pa.string()))]
                names = ["clean", "kinds"]
            else:
                values = [pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                names = ["kind", "start_pos", "end_pos"]
            yield pa.RecordBatch.from_arrays(keys + values, names=[f"c{c}" for c in range(carried)] + names)

    return run


def _prepared(df: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, str]:
    column = F.col(f"`{text}`")
    rows = df.where(column.isNotNull()).select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keys)], column.alias("_text"))
    return rows, ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keys)))


def personal_items(df: DataFrame, keys: list[str], text: str, common: str | Commonness) -> DataFrame:
    """One row per occurrence: ``keys``, ``kind``, ``start_pos``, ``end_pos`` in code points of the raw text (problem 2).

    Method: a skip-chain conditional random field. Its nodes are the places where an item may begin, its states
    "nothing" and every reading of the item there (a name of one or two given characters). Neighbours within
    forty characters share potentials by their labels, readings of the same or a similar surface, however distant, by
    being chosen together; readings that overlap exclude each other. Loopy message passing gives each reading's
    probability within its document. All weights are trained jointly on labelled documents made by
    ``pii_samples``; ``common`` (see ``commonness``) are the corpus's frequent characters and words, which are features
    of a name and exclude none.

    Null and empty texts give no row; repeated rows give repeated rows; whole texts are read.
    """
    rows, schema = _prepared(df, keys, text)
    rows = rows.where(F.length("_text") >= 2)
    found = rows.mapInArrow(_scan(common, len(keys), False), f"{schema}, kind string, start_pos int, end_pos int")
    return found.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keys)], "kind", "start_pos", "end_pos")


def redact(df: DataFrame, keys: list[str], text: str, common: str | Commonness) -> DataFrame:
    """``keys``, ``clean`` (typed placeholders in place of the items) and ``kinds`` (of the items, in order); nulls are left out."""
    rows, schema = _prepared(df, keys, text)
    found = rows.mapInArrow(_scan(common, len(keys), True), f"{schema}, clean string, kinds array<string>")
    return found.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keys)], "clean", "kinds")
