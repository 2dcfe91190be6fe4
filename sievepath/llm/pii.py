"""Personal information in free text: a skip-chain conditional random field over tokens.

Tokens are characters of Chinese, words, punctuation, and form tokens: what permissive forms read as
an address of mail, a phone, an identity number or a street address, disguises included (full-width
and Chinese digits, "(at)", "[dot]", "#", grouped digits). Labels are O, B and I of names, and for a
form token its own kind. Tokens that no name and no form can touch are O for certain and left out,
so what remains are short segments around family characters, capitalised pairs and forms.

* Node potentials: weights of hashed templates (the token, its neighbours, pairs and triples of
  them), and dense features of form, boundary, cue and name parts, drawn to stated defaults.
* Chain edges: transition weights between neighbouring tokens of a segment.
* Skip edges: distant tokens of one document that are equal or similar (the same name in another
  order or case, one letter more, less or other, the same number) share a potential that favours
  that both or neither are entities. A clear mention so lifts or lowers the unclear ones.

Inference is exact on the chains; messages along skip edges go back and forth until they settle, then
each token takes its most probable label. All weights are fitted here, piecewise: node and chain weights by
maximum likelihood, skip weights from the agreement of labelled pairs, both over all documents: labelled fields ("Author:", titles) and checked forms are certain, their name
parts spread to other mentions, beginnings that many documents use are words and so outside, and in some turns the
model labels what it is sure of and is fitted again, unsure segments left out. The fields of all documents are kept
on disk for that, the segments of words alone each once with its number; the driver holds sums, the weights, and the
distinct names and parts that labelled fields state.

Defined cases: null and empty texts have no spans and stay as they are; very long texts are read
whole; each row is judged for itself, repeated ids included; positions count characters from 1.
"""

from __future__ import annotations

import copy
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as tx
from ._store import Scratch

KINDS = ("email", "phone", "id_number", "street_address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "name": "[NAME]"}

# Frequent family names, in characters and romanised.
_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付傅方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑景党宫费卜冷晏席卫米柏宗瞿桂全佟应臧闵苟邬边卞姬师和仇栾隋商刁沙荣巫寇桑郎甄丛仲虞敖巩明佘池查麻苑迟邝"
_DOUBLE = ("欧阳", "司马", "上官", "诸葛", "司徒", "慕容", "令狐", "皇甫", "尉迟", "公孙", "夏侯", "东方", "南宫", "端木", "长孙", "宇文", "轩辕", "闻人", "独孤", "西门")
_ROMAN = frozenset("wang li zhang liu chen yang huang zhao wu zhou xu sun ma zhu hu guo he gao lin luo zheng liang xie song tang han feng deng cao peng zeng xiao tian dong yuan pan yu jiang cai du ye cheng su wei lv lu ding ren shen yao cui zhong tan fan jin shi liao jia xia fu fang bai zou meng xiong qin qiu yin xue yan duan lei hou long tao gu mao hao gong shao wan qian dai mo kong wen ouyang situ murong sima".split())
_WIDE = str.maketrans({0xFF10 + i: str(i) for i in range(10)} | {0xFF0B: "+", 0xFF08: "(", 0xFF09: ")", 0xFF0D: "-", 0xFF38: "X", 0xFF58: "x", 0x2013: "-", 0x2014: "-", 0xFF0E: ".", 0xB7: ".", 0x3000: " "} | {0xFF21 + i: chr(65 + i) for i in range(26) if i != 23} | {0xFF41 + i: chr(97 + i) for i in range(26) if i != 23})


_PIVOT = re.compile(r"[@＠#＃]|[(\[（【{]\s*(?:at|AT|At|@)\s*[)\]）】}]|艾特")
_WORD_PIVOT = re.compile(r"(?<=\s)(?:at|AT)(?=\s)")
_WORD_DOT = re.compile(r"dot|DOT|点")
_WIDE_ANY = re.compile(r"[０-９]|（[+＋]?\d|\d）")
_LOCAL = re.compile(r"[A-Za-z0-9Ａ-Ｚａ-ｚ０-９](?:[A-Za-z0-9Ａ-Ｚａ-ｚ０-９._%+＿．\-]|(?:\s?[(\[](?:dot|DOT)[)\]]\s?))*$")
_DOTTED = r"(?:[.．]|\s*[(\[（【{]\s*(?:dot|DOT|Dot|点|\.)\s*[)\]）】}]\s*|\s+(?:dot|DOT)\s+)"
_DOMAIN = re.compile(rf"[A-Za-z0-9Ａ-Ｚａ-ｚ０-９][A-Za-z0-9Ａ-Ｚａ-ｚ０-９-]*(?:{_DOTTED}[A-Za-z0-9Ａ-Ｚａ-ｚ０-９][A-Za-z0-9Ａ-Ｚａ-ｚ０-９-]*)*{_DOTTED}[A-Za-zＡ-Ｚａ-ｚ]{{2,24}}(?![A-Za-z0-9])")
_DIGITS = re.compile(r"(?<![A-Za-z0-9.\-+/_])(?:[(\[]?\+?\d|[(\[]?\+\d)(?:(?:[ .\-]|\) ?-?|[( ]\(| ?\()?\d){6,24}(?:[ -]?[xX](?![A-Za-z]))?")
_HAN_PHONE = re.compile(r"[一幺][零〇一二三四五六七八九幺]{10}(?![零〇一二三四五六七八九幺])")
_PASSPORT = re.compile(r"[A-Z]\d{7,8}(?![A-Za-z0-9])")
_STOP = "在于到住址往从去离是位至达回由向：:，,。；;！!？?、\\s\\d（(）)“”\"'《》A-Za-z"
_NUM = r"[0-9０-９一二三四五六七八九十百千〇零]"
_ROAD_ZH = re.compile(
    rf"(?:[^{_STOP}市省]{{2,4}}省)?(?:[^{_STOP}市]{{2,4}}市)?(?:[^{_STOP}市区县]{{2,4}}[区县])?(?:[^{_STOP}镇乡]{{2,3}}[镇乡])?[^{_STOP}市区县路街]{{1,5}}?(?:大道|大街|胡同|路|街|巷|里|道|弄)(?:第?[甲乙丙丁]?{_NUM}{{1,6}}(?:[-—－之]{_NUM}{{1,4}})?\s?弄)?\s?第?[甲乙丙丁]?{_NUM}{{1,6}}(?:[-—－之]{_NUM}{{1,4}})?\s?[号號](?:院|楼)?(?:{_NUM}{{1,4}}(?:栋|幢|号楼|座|单元|楼|层|室|号)|[A-Za-z]座|[A-Za-z]\d{{0,4}}室?|{_NUM}{{2,5}})*"
)
_ROAD_ZH_HIT = re.compile(rf"(?<=[路街道同巷里弄])\s?第?[甲乙丙丁]?{_NUM}")
_UNIT = r"(?:Flat|FLAT|Apt\.?|APT|Apartment|Unit|Suite|Room|Rm\.?)\s*\.?\s*#?\d{1,5}[A-Za-z]?"
_ROAD_EN = re.compile(
    rf"(?<![A-Za-z0-9])(?:{_UNIT},?\s+)?(?:No\.?\s*)?\d{{1,5}}(?:-\d{{1,4}})?[A-Za-z]?,?\s+(?:[A-Z][A-Za-z'’-]+\s+){{1,3}}(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Close|Drive|Court|Ct|Way|Place|Pl|Terrace|Square|Sq|Row|Walk|Hill|Crescent|Gardens|Boulevard|Blvd|Mews|ROAD|STREET|AVENUE|LANE)\b\.?(?!\s+[A-Z][a-z]+\s+[a-z])(?:,?\s+{_UNIT})?(?:,\s*[A-Z][a-z]+(?:-[A-Za-z]+)*(?![A-Za-z]))?"
)
_ROAD_EN_HIT = re.compile(r"\d[A-Za-z]?,? [A-Z][A-Za-z]")
_PAIR = re.compile(r"(?=((?<![A-Za-z'’-])[A-Z][A-Za-z'’-]+(?:, ?|,? [A-Z]\. ?| {1,2}| ?[·•] ?)[A-Z]['’A-Za-z]))")
_WORD = re.compile(r"(?<![A-Za-z'’-])(?:[A-Z]['’][A-Z][A-Za-z]+|[A-Z][a-z]+(?:[-'’][A-Z]?[a-z]+)*|[A-Z]{2,}(?:[-'’][A-Z]+)*)(?![A-Za-z])")
_BETWEEN = re.compile(r"(?: |, ?|,? [A-Z]\. ?|[ \t]*[·•][ \t]*|  )\Z")

_CUE_LEFT = {
    "email": re.compile(r"(?:邮箱|邮件|写信|发到|e-?mail|write to|mailbox|mail|回复|reply|<|contact)[^。\n]{0,40}$", re.I),
    "phone": re.compile(r"(?:电话|手机|拨打|微信|联系|致电|短信|号码|phone|call|tel|mobile|whatsapp|text|reach|ring|contact)[^。.!?\n]{0,50}$", re.I),
    "id_number": re.compile(r"(?:身份证|证件|护照|社保|passport|social security|ssn|\bid (?:no|number|card))[^。!?\n]{0,30}$", re.I),
    "street_address": re.compile(r"(?:地址|住在|住址|搬到|寄到|送到|lives? (?:at|on)|moved to|address|deliver|ship|send)[^。!?\n]{0,30}$", re.I),
}
_AGAINST = re.compile(r"(?:订单号?|运单号?|流水号?|批次|编号|书号|内容|版本|样本量|单号|型号|时间是|快递|ISBN|order|batch|version|sample|tracking|invoice|serial|run|item|part|model|catalogue|reference|ref)(?: ?(?:no|number|id|lists)\.?)?[ :：#]{0,3}(?:ISBN ?)?$", re.I)
# Fields, relations and titles that introduce a name; frequent words that begin like one; words and characters that are no part of one or
# may follow one; frequent given and family names.
_FIELD_ZH = "(?:作者|收件人|联系人|姓名|署名|签名)"
_RELATIONS = "(?:作者|收件人|联系人|姓名|署名|同事|朋友|邻居|老乡|同学|老师|医生|经理|名叫|叫做|感谢|——|--)[：:\\s]{0,2}"
_RELATION_ZH, _RELATION_ANY = re.compile(_RELATIONS + "$"), re.compile(_RELATIONS)
_FIELD_EN = r"(?:[Aa]uthor:|[Cc]ontact:|[Nn]ame:|[Aa]ttn:|[Rr]ecipient:|[Dd]r\.|[Mm]r\.|[Mm]rs\.|[Mm]s\.|[Pp]rof\.)"
_RELATION_EN = re.compile(r"(?:author|contact|name|attn|recipient|according to|thanks to|dr\.|mr\.|mrs\.|ms\.|prof\.|neighbou?r|colleague|friend|met|dear|by|with|from|—|--)[:,]?\s{1,2}$", re.I)
_AFTER_EN = re.compile(r"(?:\s(?:moved|told|wrote|agreed|thinks?|thought|lives?|lived|said|says|asked|took|and|in|for)\b|,? ?<|\s?[（(][+\d(])")
_FOLLOW = frozenset("说在和与是的了也都就将会要把被给对向从让请帮写认告同提接去来昨今明前后想觉问答曾已有没不很先老女 \n，。！？；：、,.!?;:()（）<>/“”\"'《》【】—…·|")
_FUNCTION = frozenset("的了是在和与也都就不没有我你他她它们这那哪些个么吗呢吧啊把被给对向从以而且但或为所其之于上下里中间等很太最更再又还只个着过得地么什怎多少几年月日号元块")
_WORDS_ZH = "房东 高兴 高中 高速 高级 白天 白色 方便 方法 方面 方式 安全 安静 安排 安装 时间 时候 时代 金融 金额 文章 文化 文字 文件 马上 马路 常用 常见 江南 江山 黄金 黄色 温度 温和 温暖 程序 程度 水平 石头 田野 武器 万一 钱包 史上 康复 和平 平时 平台 平均 平安 成功 成本 成为 成长 章节 花园 花费 明白 明显 明天 易于 路上 路线 路由 包括 包子 包含 左右 单元 单位 单纯 应该 应用 应对 车站 项目 项链 连续 连接 游戏 游客 经济 管理 解释 解决 农村 农业 阳光 席位 米饭 全部 全文 全国 关于 关系 关键 简单 查看 池塘 丁香 任务 任何 向量 施工 易错 党员 宫殿 费用 费力 冷静 盛行 曲线 曲子 曾经 于是 司机 司法 谷歌 谷物 鲁莽 梅花 童年 童话 桂花 林业 顾客 顾虑 毛病 孔子 段落 雷雨 龙虾 钟头 汪洋 金属 夏天 韦编 郭外 何必 何时 罗列 宋代 唐代 唐诗".split()
_COMMON_GIVEN = frozenset("伟芳娜敏静丽强磊军洋勇艳杰娟涛明超霞平刚桂华建国红玲辉鹏宇浩婷雪琳欣怡佳嘉子涵梓轩晨俊博文思雨小晓志海燕云飞波斌峰龙梅兰凤英玉珍秀春天宏振东林森鑫淼瑞祥福德成义仁礼智信")
_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory frank alexander patrick jack mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca laura sharon cynthia kathleen amy angela anna emma nicole helen samantha katherine christine rachel maria heather diane olivia julie "
    "smith johnson williams brown jones garcia miller davis wilson anderson taylor moore jackson martin lee thompson white harris clark lewis robinson walker young allen king wright hill green adams baker nelson carter mitchell roberts turner phillips campbell parker evans edwards collins stewart morris".split()
)
_NOT_NAME = frozenset("The A An In On At My What Whoever Nobody One Most Roughly People After Before Over Under Behind For With Ask Later Dr Mr Ms Mrs Prof Version Batch Author Contact Landlord Thanks According Road Street Lane Avenue Method Engine Flat Apt Back Write Please Chapter Notes Run Order Why How On It You We They I This That See Also And But So While Although Because Our Your".split())
_PROSE_CAPS = frozenset("ISBN ID URL HTTP SSN API USA OK".split())

FEATURES = ("bias", "cue", "against", "form", "disguise", "odd")
# Defaults of the weights of form tokens, the centre of the prior.
WEIGHTS = {
    "email": (1.0, 1.0, -1.0, 3.0, 0.5, -4.0),
    "phone": (-3.0, 3.0, -5.0, 5.0, 0.0, -4.0),
    "id_number": (-3.0, 4.0, -6.0, 5.0, 0.0, -4.0),
    "street_address": (2.0, 1.5, -1.0, 2.0, 0.0, -6.0),
}


def resident_ok(code: str) -> bool:
    """Check character and birth date of an 18-character resident number."""
    if not re.fullmatch(r"\d{17}[\dXx]", code):
        return False
    total = sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(code[:17]))
    if "10X98765432"[total % 11] != code[17].upper():
        return False
    return 1850 <= int(code[6:10]) <= 2100 and 1 <= int(code[10:12]) <= 12 and 1 <= int(code[12:14]) <= 31


def _digit_kind(raw: str, left: str) -> tuple[str, float, float, bool] | None:
    """(kind, form, disguise, need cue) of a run of digits and separators."""
    plain = re.sub(r"[^\dXx]", "", raw)
    digits = plain.rstrip("Xx")
    groups = [len(g) for g in re.findall(r"\d+", raw)]
    n = len(digits)
    if len(plain) == 18 and not re.search(r"[+(.]", raw):
        return ("id_number", 1.0, float(len(groups) > 1), False) if resident_ok(plain) else None
    if plain != digits:
        return None
    if n == 9 and not re.search(r"[+(.]", raw):
        if groups == [3, 2, 4]:
            return "id_number", 0.8, 0.0, False
        if groups == [9]:
            return "id_number", 0.0, 1.0, True
        return None
    core = re.sub(r"^(?:0086|86)(?=1[3-9]\d{9}$)", "", digits)
    if re.fullmatch(r"1[3-9]\d{9}", core):
        return "phone", 1.0, float(len(groups) > 1), False
    if re.fullmatch(r"0[1-9]\d{1,2}[2-9]\d{6,7}", digits) and n in (10, 11, 12) and (len(groups) > 1 or "(" in raw):
        return "phone", 0.9, 0.0, False
    if re.fullmatch(r"(?:0086|86)0?[1-9]\d{1,2}\d{7,8}", digits) and (raw.lstrip("([").startswith(("+", "00"))):
        return "phone", 0.9, 0.0, False
    if groups in ([3, 3, 4], [1, 3, 3, 4]) and n in (10, 11):
        return "phone", 0.9, 0.0, False
    if raw.lstrip("([").startswith("+") and 8 <= n <= 15:
        return "phone", 0.9, 0.0, False
    if raw.startswith("00") and 11 <= n <= 15 and len(groups) > 1:
        return "phone", 0.8, 0.0, False
    if 7 <= n <= 12 and re.search(r"(?:电话|手机|拨打|致电|phone|call|tel|mobile)[^。.!?\n]{0,12}$", left, re.I):
        return "phone", 0.4, 0.0, True
    return None


def forms(text: str, pivot: bool = True, digit: bool = True, dense: bool = True) -> list[tuple]:
    """(start, end, kind, features, key, strong) of all form tokens, longest first; none overlap. ``strong`` is
    True or False where cue and form leave no doubt. Without a ``pivot`` of mail, a ``digit`` or seven of them
    close together (``dense``) some expressions can't match and are not tried."""
    out: list[tuple] = []
    ascii_ = text.translate(_WIDE) if digit and _WIDE_ANY.search(text) else text

    def add(s, e, kind, key, strong=None, **f):
        out.append((s, e, kind, tuple(float(f.get(x, x == "bias")) for x in FEATURES), key, strong))

    pivots = list(_PIVOT.finditer(text)) if pivot else []
    if pivot and _WORD_DOT.search(text):
        pivots += _WORD_PIVOT.finditer(text)
    for m in pivots:
        before = text[max(0, m.start() - 80) : m.start()].rstrip(" \t")
        lo = _LOCAL.search(before)
        if not lo:
            continue
        at = m.end()
        while at < len(text) and text[at] in " \t":
            at += 1
        hi = _DOMAIN.match(text, at)
        if not hi:
            continue
        mark = m.group().lower()
        dots = re.search(r"dot|点", hi.group(), re.I)
        if mark == "at" and not dots:
            continue
        s = max(0, m.start() - 80) + lo.start()
        if mark in "#＃" and not re.search("[A-Za-z]", lo.group()):
            continue
        left = text[max(0, s - 50) : s]
        url = bool(re.search(r"https?://\S*$", left))
        add(s, hi.end(), "email", lo.group().lower() + "@" + hi.group().lower(), True if mark == "@" and not url else None, cue=bool(_CUE_LEFT["email"].search(left)), form=1.0 if mark in "@＠" else 0.8, disguise=mark not in "@", odd=url)
    for m in _DIGITS.finditer(ascii_) if dense else ():
        raw, s = m.group(), m.start()
        e = m.end()
        if e < len(ascii_) and (ascii_[e].isdigit() or ascii_[e] in "%" or ascii_[e] == "-" and ascii_[e + 1 : e + 2].isdigit()):
            continue
        if raw[0] in "([" and ")" not in raw and "]" not in raw:
            raw, s = raw[1:], s + 1
        if s and ascii_[s - 1] in "([" and ")" in raw and raw.count(")") > raw.count("("):
            raw, s = ascii_[s - 1] + raw, s - 1
        left = text[max(0, s - 60) : s]
        got = _digit_kind(raw, left)
        if not got:
            continue
        kind, form, disguise, need = got
        cue = bool(_CUE_LEFT[kind].search(left))
        if need and not cue:
            continue
        against = bool(_AGAINST.search(left))
        strong = True if cue and form >= 0.8 and not against else False if against and not cue else None
        add(s, e, kind, re.sub(r"\D", "", raw)[-10:], strong, cue=cue, against=against, form=form, disguise=disguise)
    for m in _HAN_PHONE.finditer(text):
        if m.start() and text[m.start() - 1] in "零〇一二三四五六七八九幺":
            continue
        left = text[max(0, m.start() - 60) : m.start()]
        add(m.start(), m.end(), "phone", m.group(), None, cue=bool(_CUE_LEFT["phone"].search(left)), form=1.0, disguise=1)
    for m in _PASSPORT.finditer(ascii_) if dense else ():
        s = m.start() - (m.start() > 0 and ascii_[m.start() - 1 : m.start()].isupper() and ascii_[m.start() - 1].isascii())
        if s and ascii_[s - 1].isascii() and ascii_[s - 1].isalnum():
            continue
        left = text[max(0, s - 60) : s]
        cue, against = bool(_CUE_LEFT["id_number"].search(left)), bool(_AGAINST.search(left))
        add(s, m.end(), "id_number", ascii_[s : m.end()], True if cue and not against else False if against else None, cue=cue, against=against, form=0.6)
    done = 0
    for hit in _ROAD_ZH_HIT.finditer(text):
        m = _ROAD_ZH.search(text, max(done, hit.start() - 24), hit.end() + 60)
        if not m or m.start() > hit.start():
            continue
        done = m.end()
        left = text[max(0, m.start() - 40) : m.start()]
        add(m.start(), m.end(), "street_address", m.group(), None, cue=bool(_CUE_LEFT["street_address"].search(left)), form=1.0)
    last = -1
    for hit in _ROAD_EN_HIT.finditer(text) if digit else ():
        m = _ROAD_EN.search(text, max(last, hit.start() - 24, 0), hit.end() + 120)
        if not m or m.start() > hit.end():
            continue
        if m.end() <= last:
            continue
        last = m.end()
        left = text[max(0, m.start() - 40) : m.start()]
        add(m.start(), m.end(), "street_address", m.group().lower(), None, cue=bool(_CUE_LEFT["street_address"].search(left)), form=0.8)
    if len(out) < 2:
        return out
    out.sort(key=lambda c: (c[0], c[0] - c[1]))
    free: list[tuple] = []
    for c in out:  # of two that overlap the longer one stays
        if free and c[0] < free[-1][1]:
            if c[1] - c[0] > free[-1][1] - free[-1][0]:
                free[-1] = c
        else:
            free.append(c)
    return free


LABELS = 4  # O, B, I, K: outside, begin and inside of a name, the own kind of a form token
BUCKETS = 1 << 18
COMMON = 0.1  # weight in a fit of segments with no beginning but usual ones
_HAN, _LETTER, _DIGIT, _LINE, _MARK, _FORM = 1, 2, 3, 4, 5, 6
_NEVER = -40.0
# Dense features of name tokens with the default weights of B and I, the centre of the prior.
NAME_FEATURES = (
    ("family", -5.0, 0), ("given follows", 2.0, 0), ("two given follow", 1.2, 0), ("left boundary", 1.8, 0), ("left character", -3.0, 0), ("right boundary", 1.5, 0), ("cue", 3.0, 0), ("double family", 3.5, 0),
    ("first given", 0, 0.0), ("second given", 0, -0.5), ("is a given part", 0, 2.0), ("is a function word", 0, -4.0), ("boundary follows", 0, 1.5),
    ("word", -3.5, 0), ("known words", 1.8, 0), ("romanised", 1.0, 0), ("word cue", 1.8, 0), ("word right", 1.5, 0), ("comma", -1.0, 0), ("between marks", 0.5, 0), ("unusual", 4.5, 0), ("unusual pair", 3.0, 0), ("second word", 0, 2.0), ("gap", 0, 1.5),
)
_AT = {n: i for i, (n, _, _) in enumerate(NAME_FEATURES)}
TEMPLATES = ((-1,), (1,), (-2, -1), (1, 2), (2,), (2, 3), (3,), (-3, -2, -1), (3, 4))
SKIP = {"han": (3.0, 2.0), "word": (3.0, 2.0), "form": (3.0, 2.0)}  # defaults: both entities, both none


def _classes() -> np.ndarray:
    out = np.full(0x10000, _MARK, dtype=np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if "一" <= c <= "鿿" or c == "〇":
            out[i] = _HAN
        elif 0xD800 <= i <= 0xDFFF:
            continue
        elif c in "\n\r":
            out[i] = _LINE
        elif c.isspace():
            out[i] = 0
        elif c.isdigit():
            out[i] = _DIGIT
        elif c.isalpha() and not 0x2E80 <= i <= 0xFEFF:
            out[i] = _LETTER
    return out


def _flags(chars) -> np.ndarray:
    out = np.zeros(0x10000, dtype=bool)
    out[[ord(c) for c in chars if ord(c) < 0x10000]] = True
    return out


_CLASS: np.ndarray | None = None
_IS_FAMILY, _IS_FUNCTION, _IS_FOLLOW = _flags(_FAMILY), _flags(_FUNCTION), _flags(_FOLLOW)
_TITLES = np.sort(np.array([ord(d[0]) << 16 | ord(d[1]) for d in ("老师", "先生", "女士", "小姐", "同学", "教授", "医生", "经理", "老板", "师傅", "主任", "校长")], dtype=np.int64))  # fixed values
_TWO = np.sort(np.array([ord(d[0]) << 16 | ord(d[1]) for d in _DOUBLE], dtype=np.int64))
_ROAD = _flags("路街巷弄区市县镇村")
_IN_WORD = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'’-")
_SIGNS, _OPENS, _AFTER_OPEN, _LETTERS = _flags("@＠#＃艾"), _flags("([（【{"), _flags("aA@"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_POWER = np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
_SALT = np.random.default_rng(6).integers(1, 1 << 62, (len(TEMPLATES), 3), dtype=np.uint64) | np.uint64(1)


class Model:
    """All weights; without ``fit`` the stated defaults. ``given`` and ``words`` are name parts of the labelled rows."""

    def __init__(self, given=(), words=()):
        self.given, self.words = frozenset(given), frozenset(words)
        self.usual = np.sort(np.array([ord(x[0]) << 16 | ord(x[1]) for x in _WORDS_ZH], dtype=np.int64))  # beginnings that are words, no names, in the labelled rows
        self.usual_pairs: frozenset = frozenset()  # the same of capitalised words
        self.evidence = 0.0  # what it says that a beginning is not usual: nothing without rows, all from 1000 on
        self.table = None  # (BUCKETS, 3) weights of the hashed templates for B, I, K
        self.name = np.array([[b, i] for _, b, i in NAME_FEATURES], dtype=np.float64)
        self.form = {k: np.array(w, dtype=np.float64) for k, w in WEIGHTS.items()}
        t = np.zeros((LABELS, LABELS))
        t[0, 2] = t[3, 2] = _NEVER
        t[1, 0] = t[1, 1] = t[1, 3] = -8.0
        t[2, 2], t[2, 1], t[2, 3] = -1.0, -4.0, -2.0
        self.chain, self.skip = t, dict(SKIP)

    def is_given(self) -> np.ndarray:
        return _flags(self.given | _COMMON_GIVEN)


def _may_have(code: np.ndarray, cls: np.ndarray, base: np.ndarray) -> list[list[bool]]:
    """Of each text whether it may have a pivot of mail, a digit, and seven digits within 25 characters."""
    odd = code > 0xFFFF

    def texts(at: np.ndarray) -> list[bool]:
        return (np.diff(np.searchsorted(at, base)) > 0).tolist()

    small = np.minimum(code, 0xFFFF)
    near = np.flatnonzero(_OPENS[small[:-1]])
    after = small[near + 1]
    near = near[_AFTER_OPEN[after] | (cls[near + 1] == 0) | (cls[near + 1] == _LINE)]
    word = np.flatnonzero((small[1:-2] | 32 == 97) & (small[2:-1] | 32 == 116) & ~_LETTERS[small[:-3]] & ~_LETTERS[small[3:]]) + 1
    digit = np.flatnonzero((cls == _DIGIT) | odd)
    dense = np.concatenate([digit[:-6][digit[6:] - digit[:-6] <= 24] if len(digit) > 6 else digit[:0], np.flatnonzero(odd)])
    return [texts(np.sort(np.concatenate([np.flatnonzero(_SIGNS[small]), near, word]))), texts(digit), texts(np.sort(dense))]


class Field:
    """The tokens of some documents that an entity can touch, with their segments, features and skip edges."""

    def __init__(self, texts: list[str], model: Model, fitting: bool = False):
        global _CLASS
        if _CLASS is None:
            _CLASS = _classes()
        self.texts = texts
        joined = "\n".join(texts) + "\n"
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.base = np.concatenate([[0], np.cumsum(lens + 1)])  # where each document begins
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        near = np.minimum(code, 0xFFFF)
        cls = _CLASS[near]
        cls[code > 0xFFFF] = _MARK
        hyphens = np.flatnonzero((code == 39) | (code == 0x2019) | (code == 45))
        hyphens = hyphens[(hyphens > 0) & (hyphens < len(code) - 1)]
        cls[hyphens[(cls[hyphens - 1] == _LETTER) & (cls[hyphens + 1] == _LETTER)]] = _LETTER
        self.forms = [(s + b, e + b, *rest) for b, t, *may in zip(self.base.tolist(), texts, *_may_have(code, cls, self.base)) for s, e, *rest in forms(t, *may)]
        for s, e, *_ in self.forms:
            cls[s:e] = _FORM
        change = np.ones(len(cls) + 1, dtype=bool)
        change[1:-1] = (cls[1:] != cls[:-1]) | (cls[1:] == _HAN) | (cls[1:] == _LINE) | (cls[1:] == _MARK)
        for s, *_ in self.forms:
            change[s] = True
        edge = np.flatnonzero(change)
        whole = cls[edge[:-1]] != 0
        self.at, self.end = edge[:-1][whole], edge[1:][whole]
        self.code, self.cls, self.ch = code, cls[self.at], near[self.at]
        self._ids()
        self._pairs(joined, model)
        self._han(joined, model, fitting)
        if not fitting:
            self._activate()

    def narrow(self, keep: np.ndarray, marked: bool = True) -> Field:
        """The same tokens with some beginnings only; ``marked``: with the capitalised pairs and forms."""
        out = copy.copy(self)
        out.fam, out.two, out.han_dense, out.rare = self.fam[keep], self.two[keep], self.han_dense[keep], self.rare[keep]
        if not marked:
            out.pairs, out.form_of = [], np.full(len(self.form_of), -1, dtype=np.int64)
        out._activate()
        return out

    def _ids(self) -> None:
        ids = self.ch.astype(np.uint64)
        words = np.flatnonzero(self.cls == _LETTER)
        if len(words):
            n = self.end[words] - self.at[words]
            first = np.cumsum(n) - n
            offset = np.arange(int(n.sum())) - np.repeat(first, n)
            c = self.code[np.repeat(self.at[words], n) + offset].astype(np.uint64)
            c = np.where((c >= 65) & (c <= 90), c + np.uint64(32), c)
            ids[words] = np.add.reduceat((c + np.uint64(1)) * _POWER[offset & 63], first) | np.uint64(1 << 62)
        digits = self.cls == _DIGIT
        ids[digits] = np.uint64(1 << 40) + np.minimum(self.end[digits] - self.at[digits], 9).astype(np.uint64)
        self.form_of = np.full(len(ids), -1, dtype=np.int64)
        if self.forms:
            tok = np.searchsorted(self.at, np.array([f[0] for f in self.forms]))
            self.form_of[tok] = np.arange(len(tok))
            ids[tok] = np.uint64(1 << 41) + np.array([KINDS.index(f[2]) for f in self.forms], dtype=np.uint64)
        self.ids = ids

    def _pairs(self, joined: str, model: Model) -> None:
        """Capitalised pairs: (first token, last token, dense features)."""
        self.pairs = []
        capital = (self.code >= 65) & (self.code <= 90)
        capital[1:] &= ~_IN_WORD[np.minimum(self.code[:-1], 0xFFFF)]
        for begin in np.flatnonzero(capital).tolist():
            hit = _PAIR.match(joined, begin)
            first = hit and _WORD.match(joined, begin)
            second = first and _WORD.search(joined, first.end(), first.end() + 64)
            if not second:
                continue
            x, y, gap = first.group(), second.group(), joined[first.end() : second.start()]
            if len(gap) > 6 or not _BETWEEN.match(gap) or x in _NOT_NAME or y in _NOT_NAME or x in _PROSE_CAPS or y in _PROSE_CAPS or x.isupper() != y.isupper():
                continue
            s, e = first.start(), second.end()
            i, j = np.searchsorted(self.at, s), np.searchsorted(self.at, second.start())
            if i >= len(self.at) or j >= len(self.at) or self.at[i] != s or self.end[j] != e or self.cls[j] != _LETTER or self.cls[i] != _LETTER:
                continue
            left, right = joined[max(0, s - 24) : s], joined[e : e + 16]
            lx, ly = x.lower(), y.lower()
            known = sum(w in model.words or w in _NAMES for w in (lx, ly))
            marks = (not left.strip() or left.rstrip()[-1:] in "。，,.!?;:：；！？(（—-\n") and (not right or right[0] in "。，,.!?;:：；！？)）\n")
            self.pairs.append((int(i), int(j), {"word": 1, "known words": known, "romanised": lx in _ROMAN or ly in _ROMAN, "word cue": bool(_RELATION_EN.search(left) or _RELATION_ZH.search(left)), "word right": bool(_AFTER_EN.match(right)), "comma": "," in gap, "between marks": marks, "unusual pair": model.evidence * ((lx, ly) not in model.usual_pairs)}, (lx, ly)))

    def _han(self, joined: str, model: Model, fitting: bool) -> None:
        """Family characters that may begin a name: all but usual beginnings without a cue. A fit sees those
        too, with the weight COMMON, as names not meant."""
        n, given = len(self.at), model.is_given()
        ch = np.concatenate([self.ch, np.zeros(4, dtype=self.ch.dtype)])
        han = np.concatenate([self.cls == _HAN, np.zeros(4, dtype=bool)])
        at = np.concatenate([self.at, np.full(4, -1)])
        fam = np.flatnonzero(_IS_FAMILY[self.ch] & (self.cls == _HAN) | np.isin(self.ch, _TWO >> 16))
        two = np.isin(ch[fam].astype(np.int64) << 16 | ch[fam + 1], _TWO) & han[fam + 2] & (at[fam + 2] == at[fam] + 2)
        keep = two | _IS_FAMILY[ch[fam]] & han[fam + 1] & (at[fam + 1] == at[fam] + 1) & ~_IS_FUNCTION[ch[fam + 1]]
        keep &= ~np.isin(ch[fam + 1].astype(np.int64) << 16 | ch[fam + 2], _TITLES) | two
        keep &= ~np.isin(fam, fam[two] + 1)  # the second half of a double name begins none
        fam, two = fam[keep], two[keep]
        step = np.where(two, 2, 1)
        g1, g2 = fam + step, fam + step + 1
        first, second = given[ch[g1]] & han[g1], given[ch[g2]] & han[g2] & (at[g2] == at[g1] + 1)
        cued = np.zeros(len(self.code) + 1, dtype=bool)
        for m in _RELATION_ANY.finditer(joined):
            cued[m.end()] = True
        cue = cued[self.at[fam]]
        before = np.maximum(fam - 1, 0)
        touching = (fam > 0) & (self.end[before] == self.at[fam])
        left = ~(touching & (self.cls[before] == _HAN))
        after1, after2 = self._follows(g1 + 1, self.end[g1], n), self._follows(np.minimum(g2, n - 1) + 1, self.end[np.minimum(g2, n - 1)], n)
        right = after1 | after2 & han[g2] & ~_IS_FUNCTION[ch[g2]]
        usual = np.isin(ch[fam].astype(np.int64) << 16 | ch[fam + 1], model.usual) & ~two
        keep = ~usual | cue
        if fitting:
            keep[:] = True
        self.fam, self.two = fam[keep], two[keep]
        self.han_dense = np.stack([x[keep].astype(np.float64) for x in (first, first & second, left, ~left & ~cue, right & ~_ROAD[ch[g1]], cue, two)], axis=1)
        self.given, self.chars, self.rare = given, ch, ~usual[keep] * model.evidence

    def _follows(self, token: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """Whether a boundary, a blank or a word that may follow a name comes next."""
        inside = np.minimum(token, n - 1)
        return (token >= n) | (self.at[inside] > end) | (self.cls[inside] != _HAN) | _IS_FOLLOW[self.ch[inside]]

    def _activate(self) -> None:
        n = len(self.at)
        active = np.zeros(n + 8, dtype=bool)
        for k in range(-1, 4):
            active[np.maximum(self.fam + k, 0)] = True
        active[np.minimum(self.fam[self.two] + 4, n)] = True
        for i, j, *_ in self.pairs:
            active[max(i - 1, 0) : j + 2] = True
        where = np.flatnonzero(self.form_of >= 0)
        active[where] = True
        tok = np.flatnonzero(active[:n])
        doc = np.searchsorted(self.base, self.at[tok], side="right") - 1
        new = np.ones(len(tok), dtype=bool)
        new[1:] = (tok[1:] != tok[:-1] + 1) | (doc[1:] != doc[:-1])
        self.tok, self.doc, self.start = tok, doc, np.flatnonzero(new)
        self.size = np.diff(np.concatenate([self.start, [len(tok)]]))
        slot = np.full(n + 8, -1, dtype=np.int64)
        slot[tok] = np.arange(len(tok))
        m = len(tok)
        allowed = np.zeros((m, LABELS), dtype=bool)
        allowed[:, 0] = True
        dense = np.zeros((m, len(NAME_FEATURES)))
        b = slot[self.fam]
        allowed[b, 1] = True
        dense[b, 0] = 1
        dense[b, 1:8] = self.han_dense
        dense[b, _AT["unusual"]] = self.rare
        for k, single in ((1, True), (2, True), (1, False), (2, False), (3, False)):
            f = self.fam[~self.two] if single else self.fam[self.two]
            t = f + k
            t = t[(t < n)]
            t = t[(self.cls[t] == _HAN) & (self.at[t] == self.at[t - k] + k)]
            s = slot[t]
            allowed[s, 2] = True
            if k == (2 if single else 3):
                dense[s, _AT["second given"]] = 1
                dense[s, _AT["is a given part"]] = self.given[self.ch[t]]
                dense[s, _AT["is a function word"]] = _IS_FUNCTION[self.ch[t]]
                dense[s, _AT["boundary follows"]] = self._follows(t + 1, self.end[t], n)
            else:
                dense[s, _AT["first given"]] = 1
        for i, j, f, _ in self.pairs:
            allowed[slot[i], 1] = allowed[slot[j], 2] = True
            for name, v in f.items():
                dense[slot[i], _AT[name]] = float(v)
            dense[slot[j], _AT["second word"]] = 1
            for k in range(i + 1, j):
                allowed[slot[k], 2] = True
                dense[slot[k], _AT["gap"]] = 1
        self.form_slot = slot[where]
        self.form_at = self.form_of[where]
        allowed[self.form_slot, 3] = True
        self.allowed, self.dense, self.slot = allowed, dense, slot
        ids = np.concatenate([np.zeros(4, np.uint64), self.ids, np.zeros(5, np.uint64)])
        self.hashed = np.empty((m, len(TEMPLATES)), dtype=np.int32)
        for k, offsets in enumerate(TEMPLATES):
            h = np.full(m, k + 1, dtype=np.uint64)
            for w, o in enumerate(offsets):
                h = (h ^ ids[tok + 4 + o]) * _SALT[k, w]
                h ^= h >> np.uint64(29)
            self.hashed[:, k] = (h >> np.uint64(20)) & np.uint64(BUCKETS - 1)

    def potentials(self, model: Model) -> np.ndarray:
        node = np.where(self.allowed, 0.0, _NEVER)
        node[:, 1:3] += self.dense @ model.name
        for kind, w in model.form.items():
            mine = [(s, self.forms[f][3]) for s, f in zip(self.form_slot.tolist(), self.form_at.tolist()) if self.forms[f][2] == kind]
            if mine:
                node[[s for s, _ in mine], 3] += np.array([x for _, x in mine]) @ w
        if model.table is not None:
            for k in range(len(TEMPLATES)):
                node[:, 1:] += model.table[self.hashed[:, k]]
        return node

    def edges(self) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(class, earlier, later) of the skip edges: each token to the one before with its key, and to the first."""
        out = []
        names = np.unique(self.slot[self.fam])
        t = self.tok[names]
        nxt = np.minimum(t + 1, len(self.at) - 1)
        out.append(("han", names, self.ids[t] * np.uint64(1 << 20) + self.ids[nxt]))
        if self.forms:
            keys = np.array([hash(self.forms[f][2:5:2]) & (1 << 63) - 1 for f in self.form_at.tolist()], dtype=np.uint64)
            out.append(("form", self.form_slot, keys))
        words, keys = [], []
        group: dict = {}
        for i, j, _, (x, y) in self.pairs:
            d = int(self.doc[self.slot[i]])
            for t, w in ((i, x), (j, y)):
                words.append(int(self.slot[t]))
                keys.append(_alike(group.setdefault(d, {}), w))
        if words:
            w, first = np.unique(np.array(words), return_index=True)
            out.append(("word", w, np.array(keys, dtype=np.uint64)[first]))
        linked = []
        for name, slots, key in out:
            order = np.lexsort((slots, key, self.doc[slots]))
            s, k, d = slots[order], key[order], self.doc[slots][order]
            same = np.zeros(len(s), dtype=bool)
            same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
            at = np.flatnonzero(same)
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(s)))) if len(s) else at
            far = at[head[at] < at - 1]
            linked.append((name, np.concatenate([s[at - 1], s[head[far]]]), np.concatenate([s[at], s[far]])))
        return linked


def _alike(seen: dict, word: str) -> int:
    """A key that equal words share, and of five letters or more those one letter apart."""
    forms_ = [word] + ([word[:k] + word[k + 1 :] for k in range(len(word))] if len(word) >= 5 else [])
    key = next((seen[f] for f in forms_ if f in seen), None)
    if key is None:
        key = len(seen) + 1
    for f in forms_:
        seen.setdefault(f, key)
    return key


_START, _LAST = np.array([1.0, 1.0, 0.0, 1.0]), np.array([1.0, 3e-4, 1.0, 1.0])


_BLOCK = 128


def _chain(node: np.ndarray, start: np.ndarray, size: np.ndarray, chain: np.ndarray, ends=None):
    """Forward and backward messages of all segments at once: (alpha, beta, node factors, transition factors). Segments
    of over _BLOCK tokens go in blocks: their transfer matrices tell each block what comes in on both sides. ``ends``: of
    each segment whether a token that is outside comes before it and after it."""
    e, a = np.exp(node - node.max(axis=1, keepdims=True)), np.exp(chain)
    head, tail = (_START, _LAST) if ends is None else (np.where(ends[0][:, None], a[0], _START), np.where(ends[1][:, None], a[:, 0], _LAST))
    head, tail = np.broadcast_to(head, (len(size), LABELS)), np.broadcast_to(tail, (len(size), LABELS))
    n = -(-size // _BLOCK)
    first = np.cumsum(n) - n
    st = np.repeat(start, n) + _BLOCK * (np.arange(int(n.sum())) - np.repeat(first, n))
    ln = np.minimum(_BLOCK, np.repeat(start + size, n) - st)
    order = np.argsort(-ln, kind="stable")
    live = np.searchsorted(-ln[order], -np.arange(_BLOCK + 1), side="left")  # blocks longer than t
    before, after = np.repeat(head, n, axis=0), np.repeat(tail, n, axis=0)
    leads = np.zeros(len(st), dtype=bool)
    leads[first] = True
    if (n > 1).any():
        long = np.flatnonzero(np.repeat(n > 1, n))
        long = long[np.argsort(-ln[long], kind="stable")]
        m = np.where(leads[long, None, None], np.eye(LABELS), a) * e[st[long]][:, None, :]
        for t in range(1, _BLOCK):
            go = int(np.searchsorted(-ln[long], -t, side="left"))
            step = (m[:go] @ a) * e[st[long[:go]] + t][:, None, :]
            m[:go] = step / step.sum(axis=(1, 2), keepdims=True)
        place = {int(k): i for i, k in enumerate(long)}
        for s in np.flatnonzero(n > 1).tolist():
            v, w = head[s], tail[s]
            for k in range(first[s], first[s] + n[s] - 1):
                v = v @ m[place[k]]
                v = v / v.sum()
                before[k + 1] = v @ a
            for k in range(first[s] + n[s] - 1, first[s], -1):
                w = m[place[k]] @ w
                w = w / w.sum()
                after[k - 1] = w
    st, before, after = st[order], before[order], after[order]
    alpha, beta = np.empty_like(e), np.empty_like(e)
    longest = int(ln.max()) if len(ln) else 0
    x = before * e[st]
    for t in range(longest):
        if t:
            x = (x[: live[t]] @ a) * e[st[: live[t]] + t]
        x = x / x.sum(axis=1, keepdims=True)
        alpha[st[: len(x)] + t] = x
    y = after
    beta[st + ln[order] - 1] = y
    for t in range(longest - 2, -1, -1):
        k = live[t + 1]
        z = (e[st[:k] + t + 1] * y[:k]) @ a.T
        y[:k] = z / z.sum(axis=1, keepdims=True)
        beta[st[:k] + t] = y[:k]
    return alpha, beta, e, a


def _marginals(alpha, beta) -> np.ndarray:
    m = alpha * beta
    return m / m.sum(axis=1, keepdims=True)


def _best(node: np.ndarray, start: np.ndarray, size: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The most probable label of every token."""
    alpha, beta, *_ = _chain(node, start, size, chain)
    return _marginals(alpha, beta).argmax(axis=1).astype(np.int8)


def settle(field: Field, model: Model, rounds: int = 12, tolerance: float = 0.02) -> np.ndarray:
    """Node potentials with what the skip edges add, passed on until no message moves by more than
    ``tolerance``, ``rounds`` times at most."""
    node = field.potentials(model)
    edges = [(model.skip[name], i, j) for name, i, j in field.edges() if len(i)]
    if not edges:
        return node
    i, j = np.concatenate([x[1] for x in edges]), np.concatenate([x[2] for x in edges])
    both = np.concatenate([np.full(len(x[1]), x[0][0]) for x in edges])
    none = np.concatenate([np.full(len(x[1]), x[0][1]) for x in edges])
    src, dst = np.concatenate([i, j]), np.concatenate([j, i])
    both, none = np.concatenate([both, both]), np.concatenate([none, none])
    twin = np.concatenate([np.arange(len(i), 2 * len(i)), np.arange(len(i))])
    segment = np.searchsorted(field.start, np.unique(src), side="right") - 1
    segment = np.unique(segment)  # only these hear of skip edges
    size = field.size[segment]
    rows = np.repeat(field.start[segment] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    start = np.cumsum(size) - size
    place = np.full(len(node), -1, dtype=np.int64)
    place[rows] = np.arange(len(rows))
    own, src, dst = node[rows], place[src], place[dst]
    message = np.zeros(len(src))
    for _ in range(rounds):
        heard = np.bincount(dst, message, minlength=len(own))
        now = own.copy()
        now[:, 1:] += heard[:, None]
        alpha, beta, *_ = _chain(now, start, size, model.chain)
        p = np.clip(_marginals(alpha, beta)[:, 0], 1e-12, 1 - 1e-12)
        cavity = np.clip(np.log1p(-p)[src] - np.log(p)[src] - message[twin], -30, 30)
        new = np.logaddexp(cavity + both, 0.0) - np.logaddexp(cavity, none)
        moved = float(np.abs(new - message).max())
        message = 0.5 * message + 0.5 * new
        if moved < tolerance:
            break
    node[:, 1:] += np.bincount(rows[dst], message, minlength=len(node))[:, None]
    return node


def spans(texts: list[str], model: Model) -> list[list[tuple]]:
    """(start, end, kind) of the entities of each text."""
    out: list[list[tuple]] = [[] for _ in texts]
    for d, *span in Kept(Field(texts, model, fitting=True), model, counted=False).spans(model):
        out[d].append(tuple(span))
    return out


_BEGINNING = re.compile(f"(?=([{_FAMILY}{''.join(sorted({d[0] for d in _DOUBLE}))}][一-鿿]))")
_TWO_WORDS = re.compile(r"(?=(?<![A-Za-z'’-])([A-Z][A-Za-z'’-]+),? ([A-Z][A-Za-z'’-]+))")
_SEED_ZH = re.compile(rf"{_FIELD_ZH}[：:\s]{{0,2}}({'|'.join(_DOUBLE)}|[{_FAMILY}])([一-鿿]{{1,2}})(?=[，,。;；\n（(/<]|\s|$)")
_SEED_EN = re.compile(rf"{_FIELD_EN}\s+([A-Z][A-Za-z'’-]+)(,?\s(?:[A-Z]\.\s?)?)([A-Z][A-Za-z'’-]+)(?=\s|[,.;<(（]|$)")


class Kept:
    """What fitting and finding need of a field, all by slot: it is made once and kept, and ``refresh`` brings in the known name
    parts. Usual beginnings without a cue begin no name: those that no field names are in ``plain``, outside for certain."""

    def __init__(self, field: Field, model: Model, seeds: np.ndarray | None = None, firm: dict | None = None, ids: list | None = None, counted: bool = True):
        firm, seeds = firm or {}, np.zeros(0, dtype=np.int64) if seeds is None else seeds
        step = np.where(field.two, 2, 1)
        around = np.concatenate([field.chars, np.zeros(4, dtype=field.chars.dtype)])
        chars = around[field.fam[:, None] + np.arange(4)].astype(np.int64).reshape(-1, 4)
        at, cls = np.concatenate([field.at, np.full(8, -1)]), np.concatenate([field.cls, np.zeros(8, dtype=field.cls.dtype)])
        g1, g2 = field.fam + step, field.fam + step + 1
        ok = np.stack([cls[g1] == _HAN, (cls[g2] == _HAN) & (at[g2] == at[g1] + 1)])
        usual = np.isin(chars[:, 0] << 16 | chars[:, 1], model.usual) & ~field.two
        last = chars[np.arange(len(chars)), step + 1] if len(chars) else np.zeros(0, dtype=np.int64)
        code = sum(chars[:, k] << (16 * k) for k in range(2)) + (chars[:, 2] << 32) * field.two
        short, whole = _among(code, seeds), _among(code + (last << (16 * (step + 1))), seeds)
        stated = np.zeros(len(chars), dtype=np.int64)
        if firm:
            where, n = np.array(sorted(firm.items()), dtype=np.int64).T
            k = np.minimum(np.searchsorted(where, field.at[field.fam]), len(where) - 1)
            stated = np.where(where[k] == field.at[field.fam], n[k], 0)
        mere = usual & (field.han_dense[:, 5] == 0)
        self.plain = None
        bare = mere & ~short & ~whole & (stated == 0)
        f, keep = field.narrow(~mere), ~mere
        if counted and bare.any():
            self.plain = _plain(field.narrow(bare, False), f, chars[bare], ok[:, bare])
        self.start, self.size, self.allowed, self.hashed = f.start, f.size, f.allowed, f.hashed
        self.dense, self.linked = f.dense.astype(np.float32), f.edges()
        self.fam, self.two, self.chars, self.ok, self.usual, self.last = f.slot[f.fam], f.two, chars[keep], ok[:, keep], usual[keep], last[keep]
        self.short, self.whole, self.firm = short[keep], whole[keep], stated[keep]
        self.part_slot = np.flatnonzero(f.dense[:, _AT["second given"]] == 1)
        self.part_char = f.ch[f.tok[self.part_slot]]
        self.pairs = [(int(f.slot[i]), int(f.slot[j]), pair, int(f.at[i]) in firm) for i, j, _, pair in f.pairs]
        self.form_slot = f.form_slot
        mine = [f.forms[k] for k in f.form_at.tolist()]
        self.form_kind = np.array([KINDS.index(x[2]) for x in mine], dtype=np.int64)
        self.form_x = np.array([x[3] for x in mine], dtype=np.float64).reshape(-1, len(FEATURES))
        self.strong = np.array([-1 if x[5] is None else int(x[5]) for x in mine], dtype=np.int64)
        self.doc = f.doc.astype(np.int32)
        self.at, self.end = (f.at[f.tok] - f.base[f.doc]).astype(np.int32), (f.end[f.tok] - f.base[f.doc]).astype(np.int32)
        self.form_end = np.array([x[1] for x in mine], dtype=np.int64) - f.base[f.doc[f.form_slot]]
        self.ids = ids

    def spans(self, model: Model) -> list[tuple]:
        """(document, start, end, kind) of the entities."""
        if not len(self.start):
            return []
        self.refresh(model)
        label = _best(settle(self, model), self.start, self.size, model.chain)
        out = [(int(self.doc[s]), int(self.at[s]), int(e), KINDS[k]) for s, e, k in zip(self.form_slot.tolist(), self.form_end.tolist(), self.form_kind.tolist()) if label[s] == 3]
        inside = np.concatenate([label == 2, [False]])
        longest = np.full(len(label), 8)  # a family name of one or two characters and two more; words and what is between
        longest[self.fam] = np.where(self.two, 4, 3)
        for s in np.flatnonzero(label == 1).tolist():
            e, most = s + 1, s + longest[s]
            while e < most and inside[e] and self.doc[e] == self.doc[s]:
                e += 1
            if e > s + 1:
                out.append((int(self.doc[s]), int(self.at[s]), int(self.end[e - 1]), "name"))
        return sorted(out)

    def refresh(self, model: Model) -> None:
        given = model.is_given()
        rows, step = np.arange(len(self.fam)), np.where(self.two, 2, 1)
        first = given[self.chars[rows, step]] & self.ok[0] if len(rows) else np.zeros(0, dtype=bool)
        second = given[self.last] & self.ok[1]
        self.dense[self.fam, _AT["given follows"]] = first
        self.dense[self.fam, _AT["two given follow"]] = first & second
        self.dense[self.part_slot, _AT["is a given part"]] = given[self.part_char]
        for i, _, pair, _ in self.pairs:
            self.dense[i, _AT["known words"]] = sum(w in model.words or w in _NAMES for w in pair)

    def potentials(self, model: Model) -> np.ndarray:
        node = np.where(self.allowed, 0.0, _NEVER)
        node[:, 1:3] += self.dense @ model.name
        for kind, w in model.form.items():
            mine = self.form_kind == KINDS.index(kind)
            node[self.form_slot[mine], 3] += self.form_x[mine] @ w
        if model.table is not None:
            for k in range(len(TEMPLATES)):
                node[:, 1:] += model.table[self.hashed[:, k]]
        return node

    def edges(self) -> list[tuple[str, np.ndarray, np.ndarray]]:
        return self.linked

    def labels(self, model: Model, trained: bool) -> tuple[np.ndarray, np.ndarray]:
        """(label, certain) of the tokens. Field names, mentions made of their parts and checked forms are certain; all
        else is labelled by the model where that leaves no doubt. Before the first fit only clear refusals count."""
        m = len(self.allowed)
        alpha, beta, *_ = _chain(settle(self, model, 4), self.start, self.size, model.chain)
        p = _marginals(alpha, beta)
        label = p.argmax(axis=1).astype(np.int8)
        sure = p[np.arange(m), label] > np.where(label > 0, 0.5, 0.99)
        if not trained:
            label = np.zeros(m, dtype=np.int8)
            sure = p[:, 0] > 0.98
        for k in (0, 1):
            label[self.fam[self.usual] + k], sure[self.fam[self.usual] + k] = 0, True
        step = np.where(self.two, 2, 1)
        again = np.where(self.whole, step + 2, np.where(self.short & ~_flags(model.given)[self.last], step + 1, 0))
        n = np.where(self.firm > 0, self.firm, again)
        for s, k in zip(self.fam[n > 0].tolist(), n[n > 0].tolist()):
            label[s], sure[s : s + k] = 1, True
            label[s + 1 : s + k] = 2
        for s, e, pair, firm in self.pairs:
            if firm or pair[0] in model.words and pair[1] in model.words:
                label[s], sure[s : e + 1] = 1, True
                label[s + 1 : e + 1] = 2
        told = self.strong >= 0
        label[self.form_slot[told]], sure[self.form_slot[told]] = 3 * self.strong[told], True
        return label, sure

    def parts(self, model: Model) -> Counter:
        """How often each character and word is a part of a certain name."""
        label, sure = self.labels(model, True)
        out: Counter = Counter()
        for r, (s, two) in enumerate(zip(self.fam.tolist(), self.two.tolist())):
            if label[s] == 1 and sure[s]:
                k = 2 if two else 1
                while s + k < len(label) and k < 4 and label[s + k] == 2:
                    out["g", chr(self.chars[r, k])] += 1
                    k += 1
        for s, _, pair, _ in self.pairs:
            if label[s] == 1 and sure[s]:
                out.update(("w", w) for w in pair)
        return out


_FIELD_ENDS, _FIELD_LAST = re.compile(r"[efnrst][:.]\s+[A-Z]"), re.compile(_FIELD_EN + r"\Z")


def _stated_en(text: str):
    """What _SEED_EN finds, looked for only where a field or title may end."""
    last = 0
    for hit in _FIELD_ENDS.finditer(text):
        end = hit.start() + 2
        field = _FIELD_LAST.search(text, max(last, end - 12), end)
        m = field and _SEED_EN.match(text, field.start())
        if m:
            last = m.end()
            yield m


def _first_counts(texts) -> Counter:
    """Of some texts: how many there are ("t") and use a beginning (a family character and the next) or a capitalised pair ("u"); how often fields name
    a beginning ("n") and a whole name ("s"), and the parts of these names, characters ("g") and words ("w")."""
    n: Counter = Counter()
    for t in texts:
        n["t", ""] += 1
        n.update({*(("u", x) for x in _BEGINNING.findall(t)), *(("u", f"{a} {b}".lower()) for a, b in _TWO_WORDS.findall(t))})
        for m in _SEED_ZH.finditer(t):
            n["s", m[1] + m[2]] += 1
            n["n", (m[1] + m[2])[:2]] += 1
            n.update(("g", c) for c in m[2])
        for m in _stated_en(t):
            if m[1] not in _NOT_NAME and m[3] not in _NOT_NAME:
                n.update((("w", m[1].lower()), ("w", m[3].lower())))
    return n


def _firm(texts: list[str]) -> dict:
    """Where the names of fields begin in the joined texts, with their number of tokens."""
    out, base = {}, 0
    for t in texts:
        for m in _SEED_ZH.finditer(t):
            out[base + m.start(1)] = len(m[1] + m[2])
        for m in _stated_en(t):
            if m[1] not in _NOT_NAME and m[3] not in _NOT_NAME:
                out[base + m.start(1)] = 2
        base += len(t) + 1
    return out


def _usual_bound(n: int, share: float = 0.004, least: int = 3) -> float:
    """Beginnings and capitalised pairs that more texts than this use are words, no persons."""
    return max(least, share * n)


def _learn_usual(model: Model, n: int, often: dict, named: dict) -> None:
    """``often``: the beginnings and pairs of more than _usual_bound of all ``n`` texts; a beginning that fields name often enough is a person's after all."""
    model.evidence = float(np.clip(np.log(max(n, 1) / 20) / np.log(50), 0, 1))
    words = [x for x, k in often.items() if named.get(x, 0) < max(2, 0.05 * k)]
    model.usual = np.union1d(model.usual, np.array([ord(x[0]) << 16 | ord(x[1]) for x in words if " " not in x], dtype=np.int64))
    model.usual_pairs = frozenset(tuple(x.split(" ")) for x in words if " " in x)


def _code(name: str) -> int:
    """Up to four characters as one number."""
    x = sum(ord(c) << (16 * k) for k, c in enumerate(name))
    return x - (1 << 64) if x >> 63 else x


def _codes(names) -> np.ndarray:
    return np.sort(np.array([_code(x) for x in names], dtype=np.int64))


def _count_batches(batches):
    for batch in batches:
        n = _first_counts(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["what", "x", "n"])


def _keeper(sent, places: int):
    """Rows (place, plain, data): the fields of blocks of texts, at any place, and the task's plain segments, equal ones at one place."""

    def run(batches):
        held: list = []

        def plain_rows():
            plain = _joined_up(held)
            at = (_keys(plain[0], *plain[2:]) >> np.uint64(20)) % np.uint64(places)
            for k in np.unique(at).tolist():
                yield k, True, _packed(_chosen(np.flatnonzero(at == k), *plain))

        for batch in batches:
            model, seeds = sent.value
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for a, e in tx.blocks(texts):
                part = texts[a:e]
                kept = Kept(Field(part, model, fitting=True), model, seeds, _firm(part), ids[a:e])
                if kept.plain is not None:
                    held.append(kept.plain)
                    kept.plain = None
                    if len(held) > 11:
                        held[:] = [_joined_up(held)]
                    if len(held[0][0]) > 250_000:
                        out += plain_rows()
                        held.clear()
                if len(kept.start):
                    out.append((zlib.crc32(part[0].encode("utf-8", "surrogatepass")) % places, False, pickle.dumps(kept, protocol=5)))
            yield _blobs(out)
        if held:
            yield _blobs(list(plain_rows()))

    return run


_BLOBS = "place int, plain boolean, data binary"


def _blobs(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary()))], names=["place", "plain", "data"])


def _gathered(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a place, with the plain segments as one row."""
    plain: list = []
    for batch in batches:
        rows = list(zip(*(batch.column(n).to_pylist() for n in ("plain", "data"))))
        yield _blobs([(key[0].as_py(), False, data) for is_plain, data in rows if not is_plain])
        plain += [_unpacked(data) for is_plain, data in rows if is_plain]
        if len(plain) > 8:
            plain = [_joined_up(plain)]
    if plain:
        yield _blobs([(key[0].as_py(), True, _packed(_joined_up(plain)))])


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the sorted values have x."""
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x if len(values) else np.zeros(len(x), dtype=bool)


def _cores(size: np.ndarray, allowed: np.ndarray) -> tuple:
    """The tokens that may be more than outside, as runs: (tokens, sizes, whether an outside token comes before, and after, the
    segment). The likelihood of a segment is the product of that of its runs, as nothing passes a token that is outside."""
    core = allowed[:, 1:].any(axis=1)
    first, last = np.zeros(len(core), dtype=bool), np.zeros(len(core), dtype=bool)
    first[np.cumsum(size) - size] = last[np.cumsum(size) - 1] = True
    begin = np.flatnonzero(core & (first | ~np.concatenate([[False], core[:-1]])))
    end = np.flatnonzero(core & (last | ~np.concatenate([core[1:], [False]])))
    return np.flatnonzero(core), end - begin + 1, ~first[begin], ~last[end], np.repeat(np.arange(len(size)), size)[begin]


_BITS = len(NAME_FEATURES)  # of a token of plain segments: a bit for each feature, then "may be B", "may be I", "outside before" and "outside after"


def _plain(field: Field, others: Field, chars: np.ndarray, ok: np.ndarray) -> tuple:
    """The segments of beginnings that are words for certain, equal ones once: (sizes, numbers, then of their tokens bits, hashed
    templates, the characters that may be name parts). Those that touch segments of others count in full, not COMMON."""
    at, size, before, after, segment = _cores(field.size, field.allowed)
    active = np.zeros(len(field.at), dtype=bool)
    active[field.tok] = active[others.tok] = True
    tok = np.flatnonzero(active)
    doc = np.searchsorted(field.base, field.at[tok], side="right")
    run = np.zeros(len(field.at), dtype=np.int64)
    run[tok] = np.cumsum(np.concatenate([[True], (tok[1:] != tok[:-1] + 1) | (doc[1:] != doc[:-1])]))
    touched = np.isin(run[field.tok[field.start]], run[others.tok])[segment]
    part = np.zeros((len(field.tok), 3), dtype=np.uint16)
    b, second = field.slot[field.fam], np.flatnonzero(field.dense[:, _AT["second given"]] == 1)
    part[b, 0], part[b, 1] = np.where(ok[0], chars[:, 1], 0), np.where(ok[1], chars[:, 2], 0)
    part[second, 2] = field.ch[field.tok[second]]
    dense = field.dense[at] > 0
    dense[:, [_AT["given follows"], _AT["two given follow"], _AT["is a given part"]]] = False
    bits = np.concatenate([dense, field.allowed[at, 1:3]], axis=1) @ (1 << np.arange(_BITS + 2))
    begin = np.cumsum(size) - size
    bits[begin] |= before.astype(np.int64) << (_BITS + 2)
    bits[begin + size - 1] |= after.astype(np.int64) << (_BITS + 3)
    return _once(size, np.where(touched, 1 / COMMON, 1.0), bits, field.hashed[at], part[at])


def _joined_up(parts: list) -> tuple:
    """One of several tuples of arrays, equal segments once."""
    return _once(*map(np.concatenate, zip(*parts))) if len(parts) > 1 else parts[0]


def _packed(plain: tuple) -> bytes:
    size, n, bits, hashed, part = plain
    small = hashed.astype("<i4").view(np.uint8).reshape(*hashed.shape, 4)[..., :3]  # BUCKETS are less than three bytes
    return pickle.dumps((size.astype(np.int32), n, bits.astype(np.int32), np.ascontiguousarray(small), part), protocol=5)


def _unpacked(data: bytes) -> tuple:
    size, n, bits, small, part = pickle.loads(data)
    hashed = np.zeros((*small.shape[:2], 4), dtype=np.uint8)
    hashed[..., :3] = small
    return size.astype(np.int64), n, bits.astype(np.int64), hashed.view("<i4")[..., 0].astype(np.int32), part


class _Examples:
    """The certain segments of some fields and plain segments, as runs of tokens that may be more than outside, equal ones once with their number."""

    def __init__(self, kept, model: Model, trained: bool, plain: list | tuple = ()):
        rows: list = []
        plain = list(plain)
        self.agree: Counter = Counter()
        for field in kept:
            if field.plain is not None:
                plain.append(field.plain)
            if not len(field.start):
                continue
            field.refresh(model)
            label, sure = field.labels(model, trained)
            for name, i, j in field.edges():
                ok = sure[i] & sure[j]
                a, b = label[i[ok]] > 0, label[j[ok]] > 0
                for what, c in (("both", a & b), ("none", ~a & ~b), ("one", a != b)):
                    self.agree[name, what] += int(c.sum())
            good = np.ones(len(field.start), dtype=bool)
            good[np.repeat(np.arange(len(field.start)), field.size)[~sure]] = False
            if not good.any():
                continue
            at = np.flatnonzero(np.repeat(good, field.size))
            x = np.zeros((len(label), 1 + len(FEATURES)), dtype=np.float32)
            x[field.form_slot, 0], x[field.form_slot, 1:] = field.form_kind + 1, field.form_x
            y, allowed = label[at], field.allowed[at]
            allowed[np.arange(len(at)), y] = True
            core, size, before, after, _ = _cores(field.size[good], allowed)
            if not len(core):
                continue
            at, head = at[core], y[core].astype(np.int64) | allowed[core, 1:].astype(np.int64) @ (4 << np.arange(LABELS - 1))
            begin = np.cumsum(size) - size
            head[begin] |= before.astype(np.int64) << 5
            head[begin + size - 1] |= after.astype(np.int64) << 6
            rows.append(_once(size, np.ones(len(size)), head, field.dense[at], field.hashed[at], x[at]))
            if len(rows) > 15:
                rows = [_joined_up(rows)]
        self.positive = any((r[2] & 3 > 0).any() for r in rows)
        if plain:
            rows = ([_joined_up(rows)] if rows else []) + [_from_plain(_joined_up(plain), model)]
        elif rows:
            rows = [_joined_up(rows)]
        self.empty = not rows
        if rows:
            size, times, head, dense, hashed, x = map(np.concatenate, zip(*rows))
            # Segments of one beginning with two characters after it, outside for certain, come first: their likelihood has four terms.
            begin = np.cumsum(size) - size
            three = np.flatnonzero(size == 3)
            b = begin[three]
            three = three[(head[b] & 63 == 4 | 32) & (head[b + 1] & 63 == 8) & (head[b + 2] & 127 == 8 | 64)]
            rest = np.setdiff1d(np.arange(len(size)), three, assume_unique=True)
            self.size, self.times, head, dense, hashed, x = _chosen(np.concatenate([three, rest]), size, times, head, dense, hashed, x)
            self.three = len(three)
            self.y, first, last = (head & 3).astype(np.int8), np.cumsum(self.size) - self.size, np.cumsum(self.size) - 1
            self.ends = (head[first] >> 5 & 1).astype(bool), (head[last] >> 6 & 1).astype(bool)
            here = np.zeros(BUCKETS, dtype=bool)
            here[hashed] = True
            self.used = np.flatnonzero(here)
            place = (np.cumsum(here) - 1).astype(np.int32)
            _, one, same = np.unique(_keys(np.ones(len(dense), dtype=np.int64), dense), return_index=True, return_inverse=True)
            self.patterns = dense[one].astype(np.float64)
            self.of = []  # of each label: the tokens that may have it, their templates, and their pattern of features or form
            for k in range(1, LABELS):
                at = np.flatnonzero(head >> (k + 1) & 1)
                self.of.append((at.astype(np.int32), np.ascontiguousarray(place[hashed[at]].T), same[at].astype(np.int32) if k < 3 else x[at]))
            inner = np.ones(len(self.y), dtype=bool)
            inner[last] = False
            inner[: 3 * self.three] = False
            i = self.inner = np.flatnonzero(inner).astype(np.int32)
            self.steps = np.bincount(self.y[i].astype(np.int64) * LABELS + self.y[i + 1], np.repeat(self.times, self.size)[i], minlength=LABELS * LABELS).reshape(LABELS, LABELS)

    def gradient(self, w: np.ndarray, model: Model) -> list:
        """[used buckets, theirs, that of the name features, of the chain, then of each kind of form], without the prior."""
        w, n = w[self.used], self.three
        kinds = {kind: np.flatnonzero(self.of[2][2][:, 0] == KINDS.index(kind) + 1) for kind in WEIGHTS}
        scores, slopes = [], []
        for k, (_, flat, own) in enumerate(self.of):
            v = np.ascontiguousarray(w[:, k])
            score = np.zeros(flat.shape[1])
            for t in flat:
                score += v[t]
            if k < 2:
                score += (self.patterns @ model.name[:, k])[own]
            else:
                for kind, s in kinds.items():
                    score[s] += own[s, 1:] @ model.form[kind]
            scores.append(score)
            slopes.append(np.zeros(len(score)))
        chain = np.zeros((LABELS, LABELS))
        if n:
            self._threes(scores, slopes, chain, model.chain)
        if n < len(self.size):
            self._others(scores, slopes, chain, model.chain)
        g, name, forms_ = np.zeros((len(self.used), 3)), np.zeros((len(NAME_FEATURES), 2)), {}
        for k, ((_, flat, own), mine) in enumerate(zip(self.of, slopes)):
            if len(mine):
                g[:, k] = np.bincount(flat.ravel(), np.tile(mine, len(flat)), minlength=len(self.used))
            if k < 2:
                name[:, k] = np.bincount(own, mine, minlength=len(self.patterns)) @ self.patterns
            else:
                forms_ = {kind: own[s, 1:].T.astype(np.float64) @ mine[s] for kind, s in kinds.items()}
        return [self.used, g, name, chain, forms_]

    def _threes(self, scores: list, slopes: list, chain: np.ndarray, c: np.ndarray) -> None:
        """Of the segments with one beginning and two tokens after it: none, B, BI and BII are all that it may be."""
        n = self.three
        b, i = scores[0][:n], scores[1][: 2 * n].reshape(n, 2)
        only = b + (c[0, 1] + c[1, 0] - 2 * c[0, 0])
        two = b + i[:, 0] + (c[0, 1] + c[1, 2] + c[2, 0] - 3 * c[0, 0])
        three = two + i[:, 1] + (c[2, 2] - c[0, 0])
        top = np.maximum(np.maximum(only, two), np.maximum(three, 0))
        p1, p2, p3 = np.exp(only - top), np.exp(two - top), np.exp(three - top)
        share = self.times[:n] / (np.exp(-top) + p1 + p2 + p3)
        p1, p2, p3 = p1 * share, p2 * share, p3 * share
        slopes[0][:n] = -(p1 + p2 + p3)
        slopes[1][: 2 * n : 2], slopes[1][1 : 2 * n : 2] = -(p2 + p3), -p3
        s1, s2, s3 = p1.sum(), p2.sum(), p3.sum()
        chain[0, 0] += 2 * s1 + 3 * s2 + 4 * s3
        chain[0, 1] -= s1 + s2 + s3
        chain[1, 0] -= s1
        chain[1, 2] -= s2 + s3
        chain[2, 0] -= s2 + s3
        chain[2, 2] -= s3

    def _others(self, scores: list, slopes: list, chain: np.ndarray, c: np.ndarray) -> None:
        before, ends = 3 * self.three, (self.ends[0][self.three :], self.ends[1][self.three :])
        size, y = self.size[self.three :], self.y[before:]
        start, times = np.cumsum(size) - size, np.repeat(self.times[self.three :], size)
        node = np.full((len(y), LABELS), _NEVER)
        node[:, 0] = 0.0
        skip = (self.three, 2 * self.three, 0)
        for k, (at, *_) in enumerate(self.of):
            node[at[skip[k] :] - before, k + 1] = scores[k][skip[k] :]
        alpha, beta, e, a = _chain(node, start, size, c, ends)
        d = -_marginals(alpha, beta)
        d[np.arange(len(y)), y] += 1
        d *= times[:, None]
        i = self.inner - before
        after = (e * beta)[i + 1]
        chain += self.steps - (alpha[i] * (times[i] / ((alpha[i] @ a) * after).sum(axis=1))[:, None]).T @ after * a
        chain[0] += d[start[ends[0]]].sum(axis=0)
        chain[:, 0] += d[(start + size - 1)[ends[1]]].sum(axis=0)
        for k, (at, *_) in enumerate(self.of):
            slopes[k][skip[k] :] = d[at[skip[k] :] - before, k + 1]


def _from_plain(plain: tuple, model: Model) -> tuple:
    """Plain segments as examples, with the name parts known now; each counts COMMON."""
    size, n, bits, hashed, part = plain
    given = model.is_given()[part]
    dense = (bits[:, None] >> np.arange(_BITS) & 1).astype(np.float32)
    dense[:, _AT["given follows"]], dense[:, _AT["two given follow"]], dense[:, _AT["is a given part"]] = given[:, 0], given[:, 0] & given[:, 1], given[:, 2]
    head = (bits >> _BITS & 3) << 2 | (bits >> (_BITS + 2) & 3) << 5
    return size, n * COMMON, head, dense, hashed, np.zeros((len(bits), 1 + len(FEATURES)), dtype=np.float32)


def _keys(size: np.ndarray, *tokens: np.ndarray) -> np.ndarray:
    """A number for each segment, the same for equal ones."""
    raw = np.concatenate([(x * 64 if x.dtype.kind == "f" else x).astype(np.int64).reshape(len(x), -1) for x in tokens], axis=1).astype(np.uint64)
    key = raw @ np.random.default_rng(8).integers(1, 1 << 62, raw.shape[1], dtype=np.uint64)
    key ^= key >> np.uint64(31)
    start = np.cumsum(size) - size
    place = np.arange(len(key)) - np.repeat(start, size)
    key = (key + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93) | np.uint64(1))
    key ^= key >> np.uint64(29)
    return np.add.reduceat(key * np.uint64(0xD6E8FEB86659FD93), start) + size.astype(np.uint64)


def _chosen(which: np.ndarray, size: np.ndarray, times: np.ndarray, *tokens: np.ndarray) -> tuple:
    """Some of the segments."""
    start = np.cumsum(size) - size
    n = size[which]
    take = np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return n, times[which], *(x[take] for x in tokens)


def _once(size: np.ndarray, times: np.ndarray, *tokens: np.ndarray) -> tuple:
    """Equal segments once, their numbers added up."""
    _, first, which = np.unique(_keys(size, *tokens), return_index=True, return_inverse=True)
    size, _, *tokens = _chosen(first, size, times, *tokens)
    return size, np.bincount(which, times), *tokens


def _sum_gradients(parts) -> tuple:
    total = None
    for part in parts:
        if total is None:
            total = (np.zeros((BUCKETS, 3)), np.zeros(BUCKETS, dtype=bool), part[2], part[3], part[4])
        else:
            total = (total[0], total[1], total[2] + part[2], total[3] + part[3], {k: v + part[4][k] for k, v in total[4].items()})
        total[0][part[0]] += part[1]
        total[1][part[0]] = True
    return total


class _Here:
    """Fields of this process, as fitting goes over them; ``_Spread`` does the same on the executors."""

    def __init__(self, kept: list):
        self.kept = kept

    def label(self, model: Model, trained: bool) -> tuple[bool, Counter]:
        self.examples = _Examples(self.kept, model, trained)
        return self.examples.positive, self.examples.agree

    def gradient(self, w: np.ndarray, model: Model) -> tuple:
        return _sum_gradients([self.examples.gradient(w, model)])

    def parts(self, model: Model) -> Counter:
        return sum((k.parts(model) for k in self.kept if len(k.start)), Counter())


class _Spread:
    def __init__(self, spark: SparkSession, blocks: DataFrame):
        self.sc, self.examples, self.blocks = spark.sparkContext, None, blocks.select("plain", "data").rdd
        self.held = blocks.where("not plain").select("data").rdd

    def label(self, model: Model, trained: bool) -> tuple[bool, Counter]:
        if self.examples is not None:
            self.examples.unpersist()
        sent = self.sc.broadcast(model)

        def run(rows):
            held: list = []
            for r in rows:
                if r[0]:
                    yield _Examples((), sent.value, trained, [_unpacked(r[1])])
                else:
                    held.append(pickle.loads(r[1]))
                if sum(len(k.allowed) for k in held) > 250_000:
                    yield _Examples(held, sent.value, trained)
                    held = []
            if held:
                yield _Examples(held, sent.value, trained)

        self.examples = self.blocks.mapPartitions(run).persist(StorageLevel.DISK_ONLY)
        said = self.examples.map(lambda x: (x.positive, x.agree)).collect()
        return any(p for p, _ in said), sum((c for _, c in said), Counter())

    def gradient(self, w: np.ndarray, model: Model) -> tuple:
        used = Model()
        used.name, used.form, used.chain = model.name, model.form, model.chain
        sent = self.sc.broadcast((w, used))
        tasks = self.examples.coalesce(max(1, min(self.sc.defaultParallelism, 32)))  # one sum a core reaches the driver

        def run(xs):
            total = _sum_gradients(x.gradient(*sent.value) for x in xs if not x.empty)
            if total is None:
                return []
            at = np.flatnonzero(total[1])
            return [[at, total[0][at], *total[2:]]]

        out = _sum_gradients(tasks.mapPartitions(run).toLocalIterator() if tasks.getNumPartitions() > 32 else tasks.mapPartitions(run).collect())
        sent.destroy()
        return out

    def parts(self, model: Model) -> Counter:
        sent = self.sc.broadcast(model)

        def run(rows):
            out: Counter = Counter()
            for r in rows:
                kept = pickle.loads(r[0])
                kept.refresh(sent.value)
                out.update(kept.parts(sent.value))
            return out.items()

        return Counter(dict(self.held.mapPartitions(run).reduceByKey(lambda a, b: a + b).collect()))


def fit(texts: list[str], strength: float = 0.5, turns: int = 10, rounds: int = 15, rate: float = 0.4) -> Model:
    """The model of some texts, all in this process."""
    n = _first_counts(texts)
    of = lambda kind: {x: k for (what, x), k in n.items() if what == kind}
    model = Model()
    _learn_usual(model, len(texts), {x: k for x, k in of("u").items() if k > _usual_bound(len(texts))}, of("n"))
    kept = [Kept(Field(texts, model, fitting=True), model, _codes(of("s")), _firm(texts))]
    return _fit(_Here(kept), model, {c for c, k in of("g").items() if k >= 2}, {w for w, k in of("w").items() if k >= 2}, len(texts), strength, turns, rounds, rate)


def _fit(over: _Here | _Spread, model: Model, given: set, words: set, n: int, strength: float = 0.5, turns: int = 10, rounds: int = 15, rate: float = 0.4) -> Model:
    """Each turn labels what it is certain of, fits node and chain weights and learns the parts of the certain names, those that
    fields name or a thousandth of the texts; skip weights come from the last labels."""
    known = (frozenset(given), frozenset(words))
    for turn in range(turns):
        if turn > 3 and known == (model.given, model.words):
            break  # nothing more to learn
        model.given, model.words = known
        positive, agree = over.label(model, turn > 0)
        if not positive:
            return model
        _climb(over, model, strength, rounds, rate)
        _fit_skips(model, agree)
        found = over.parts(model)
        new: tuple = (set(given), set(words))
        for (kind, x), k in found.items():
            if k >= max(2, n / 1000):
                new[kind == "w"].add(x)
        known = (frozenset(new[0]), frozenset(new[1]))
    return model


def _climb(over: _Here | _Spread, model: Model, strength: float, rounds: int, rate: float) -> None:
    """Maximum likelihood with a Gaussian prior at the defaults, by adaptive gradient steps over all certain segments."""
    base = Model()
    w = np.zeros((BUCKETS, 3)) if model.table is None else model.table.astype(np.float64)
    free = base.chain > _NEVER
    state: dict = {}

    def step(key, value, gradient):
        s = state.setdefault(key, np.full_like(value, 1e-2))
        s += gradient**2
        return value + rate * gradient / np.sqrt(s)

    for _ in range(rounds):
        g, used, name, chain, forms_ = over.gradient(w, model)
        w[~used] = 0
        w = step("w", w, g - 0.2 * strength * w)
        model.name = step("name", model.name, name - 5 * strength * (model.name - base.name))
        for kind, x in forms_.items():
            if x.any():
                model.form[kind] = step(kind, model.form[kind], x - 20 * strength * (model.form[kind] - base.form[kind]))
        model.chain = np.where(free, step("chain", model.chain, np.where(free, chain, 0.0) - 5 * strength * (model.chain - base.chain)), base.chain)
    model.table = w.astype(np.float32)


def _fit_skips(model: Model, agree: Counter) -> None:
    """Log odds of agreement against independence of the ends of an edge, halved as both ends count elsewhere too."""
    for name, prior in SKIP.items():
        if not any((name, x) in agree for x in ("both", "none", "one")):
            continue
        n = sum(agree[name, x] for x in ("both", "none", "one"))
        n11, n00, n10 = agree[name, "both"] + 1.0, agree[name, "none"] + 1.0, agree[name, "one"] / 2 + 1.0
        share = n / (n + 20)
        p = (n11 + n10) / (n11 + n00 + 2 * n10)
        total = n11 + n00 + 2 * n10
        both, none = np.log(n11 / total / (p * p)), np.log(n00 / total / ((1 - p) ** 2))
        cross = np.log(n10 / total / (p * (1 - p)))
        fitted = (np.clip(both - cross, 0, 6), np.clip(none - cross, 0, 6))
        model.skip[name] = tuple(float(share * f / 2 + (1 - share) * q) for f, q in zip(fitted, prior))


def mask(text: str, spans: list[tuple]) -> str:
    parts, last = [], 0
    for s, e, kind, *_ in spans:
        parts += [text[last:s], PLACEHOLDER[kind]]
        last = e
    return "".join([*parts, text[last:]])


class Finder:
    """Fitted once over a whole table of texts; ``spans`` and ``masked`` apply it to all rows. One pass counts, one keeps
    the fields, the turns go over these, and so does ``spans``."""

    def __init__(self, spark: SparkSession, documents: DataFrame, text: str = "text"):
        self.rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
        usable = self.rows.where("text is not null and text <> ''")
        scratch = Scratch(spark, "pii")
        counts = scratch.write(usable.select("text").mapInArrow(_count_batches, "what string, x string, n bigint").groupBy("what", "x").agg(F.sum("n").alias("n")), "counts")
        n = (counts.where("what = 't'").first() or {"n": 0})["n"]
        model, self.fields = Model(), None
        if n:
            often = counts.where((F.col("what") == "u") & (F.col("n") > _usual_bound(n)))
            named = counts.where("what = 'n'").join(often.select("x"), "x", "left_semi")
            of = lambda df: {r["x"]: r["n"] for r in df.select("x", "n").toLocalIterator()}
            _learn_usual(model, n, of(often), of(named))
            seeds = np.sort(np.fromiter((_code(r[0]) for r in counts.where("what = 's'").select("x").toLocalIterator()), dtype=np.int64))
            sent = spark.sparkContext.broadcast((model, seeds))
            places = max(2 * spark.sparkContext.defaultParallelism, n // 10_000)  # so that no task gathers more than a few MB
            made = scratch.write(usable.mapInArrow(_keeper(sent, places), _BLOBS), "made")
            self.fields = scratch.write(made.groupBy("place").applyInArrow(_gathered, _BLOBS), "fields")
            scratch.drop("made")
            over = _Spread(spark, self.fields)
            model = _fit(over, model, set(of(counts.where("what = 'g' and n >= 2"))), set(of(counts.where("what = 'w' and n >= 2"))), n)
            over.examples.unpersist()
        scratch.drop("counts")
        self.model = model
        self.sent = spark.sparkContext.broadcast(self.model)

    def spans(self) -> DataFrame:
        shape = "doc_id bigint, kind string, start_pos bigint, end_pos bigint"
        sent = self.sent
        if self.fields is None:
            return self.rows.sparkSession.createDataFrame([], shape)

        def run(batches):
            for batch in batches:
                for data in batch.column(0):
                    kept = pickle.loads(data.as_py())
                    flat = [(kept.ids[d], kind, s + 1, e) for d, s, e, kind in kept.spans(sent.value)]
                    cols = list(zip(*flat)) if flat else [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "kind", "start_pos", "end_pos"])

        return self.fields.where("not plain").select("data").mapInArrow(run, shape)

    def masked(self) -> DataFrame:
        sent = self.sent

        def run(batches):
            for batch in batches:
                texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
                for a, e in tx.blocks([t or "" for t in texts]):
                    found = spans([t or "" for t in texts[a:e]], sent.value)
                    done = [None if t is None else mask(t, s) for t, s in zip(texts[a:e], found)]
                    yield pa.RecordBatch.from_arrays([ids.slice(a, e - a).cast(pa.int64()), pa.array(done, pa.string()), pa.array([len(s) for s in found], pa.int64())], names=["doc_id", "masked_text", "n_spans"])

        return self.rows.mapInArrow(run, "doc_id bigint, masked_text string, n_spans bigint")
