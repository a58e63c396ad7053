"""Problem 3: personal information in free text, replaced by typed placeholders.

High-recall generators propose overlapping spans of five kinds: names, e-mail
addresses, phone numbers, identity numbers and street addresses. Boosted trees,
one model for each kind, score every span from its format and its context, and a
calibrated threshold selects; where selected spans overlap, the stronger kind
wins. Lexicons (how often a token occurs in the place of a name, endings of name
tokens) and trees are trained by ``train_personal.py`` and stored beside this
module.

The generators read the text in its consistent spelling, so that look-alike and
invisible characters hide nothing; offsets are those of the text as given.
Labels that are already in place are left. Null and empty texts have no mentions.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import boosting
from textloom.llm.common import KEY, add_column
from textloom.llm.encoding import repair_mapped
from textloom.llm.lookalikes import unify_mapped
from textloom.llm.names import GIVEN_CASELESS, HONORIFIC_BEFORE, TITLES, given, prior

MODEL = Path(__file__).with_name("models") / "personal.json"
KINDS = ("email", "id_number", "phone", "address", "name")
#: Kinds with trees of their own; names in Han characters and kana are scored apart and come out as names.
MODELS = (*KINDS, "han")
MEMO_LIMIT = 300_000

_U = "A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻŠŽČĎŇŘŤŮĂÂÎȘȚĞİŐŰА-ЯЁІЇЄΑ-ΡΣ-ΩΆΈΉΊΌΎΏ"
_L = "a-zß-öø-ÿąćęłńóśźżšžčďňřťůăâîșțğıőűа-яёіїєα-ωάέήίόύώ"
#: A word with a capital: Anna, O'Neil, MacKay, ANNA, Anna-Maria.
WORD = re.compile(rf"(?<![\w@])[{_U}](?:[{_L}]+(?:['’][{_U}]?[{_L}]+)?(?:[{_U}][{_L}]+)?|['’][{_U}][{_L}]+|[{_U}]{{2,}})(?:-[{_U}](?:[{_L}]+|[{_U}]+))*(?![\w@])")
_INITIAL = re.compile(rf"[{_U}]\.")
_LEFT_INITIAL = re.compile(rf"(?<!\w)[{_U}]\.[ \n]$")
_RIGHT_INITIAL = re.compile(rf"[ \n][{_U}]\.(?![{_L}])")
#: The sign of an address in words; texts with neither it nor an @ have no address.
_AT = re.compile(r"[(\[{]\s?(?:at|AT|małpa)\s?[)\]}]", re.A)
EMAIL = re.compile(r"[\w][\w.+'’-]*\s?(?:@|" + _AT.pattern + r")\s?[\w-]+(?:(?:\.|\s?[(\[{]\s?(?:dot|DOT|kropka)\s?[)\]}]\s?)[\w-]+)+", re.A)
#: What follows or leads the parts of code that look like an address: a call, a path; a command or a definition.
_NO_MAIL = re.compile(r"\(|:[\w/]|/\w")
_DECORATED = re.compile(r"(?:def|class|import|from|npm i|add) $")
#: The first character leads as one class, so that the scan is fast; what may not stand before it is looked at behind it.
NUMBER = re.compile(r"[+(0-9](?<![A-Za-z0-9_.,/:@#=-].)(?<!\d .)(?:(?<=\d)|\s?\(?\+?\d)(?:[\d()]|[ .\n/-](?=[\d(])|\)[ /-]?(?=\d)){5,22}(?:[ -]?[A-Z](?!\w))?(?:,? ?(?:ext\.?|wew\.?|x) ?\d+)?(?![A-Za-z0-9_@])", re.S)
_CODE_GATE = re.compile(r"[A-Z0-9](?:(?<=[A-Z])[ -]?\d|(?<=\d)-?[A-Z])")
CODE = re.compile(r"(?<![A-Za-z0-9_./-])(?:[A-Z]{1,3}[ -]?\d{3,4}[ -]?\d{3,5}[A-Z]?|[A-Z]{2} \d\d \d\d \d\d [A-Z]|[A-Z0-9]{2,3}[0-9]{3}[A-Z0-9]{3,6}|[XYZ]-?\d{7}-?[A-Z]|\d\d[A-Z]{2}\d{5}|\d{8}-?[A-Z])(?![A-Za-z0-9_-])")
#: A line end inside a number, and the label of the next item behind it.
_TAIL = re.compile(r"\n\(?\d{1,4}[.)]?$|\n(?=\d{1,4}[.)] )")
_STREET = "ul|os|al|pl|Al|Os|Ul|Pl|Avda|avda|Av|av|bd|Bd|ул|пр|пер|наб"
#: A street name, then the house number.
NAMED_STREET = re.compile(rf"[{_U}](?<![\w@.-].)[{_L}]+(?:\s(?:de|del|la|an|am|der|[{_U}][{_L}]+)){{0,3}}\s(?:nr\s)?[1-9]\d{{0,3}}(?:\s?[a-z](?!\w))?(?![\d.]|,\d|\s?[%€])", re.S)
#: The type word of a street before its name.
STREET_TYPE = re.compile(rf"(?:(?<![\w.])(?:(?:{_STREET})\.\s|C/\s?|(?:calle|Calle|Plaza|plaza|Paseo|paseo|ulica|aleja|osiedle|улица)\s)(?:(?:de|del|de la|des|von|zum)\s)*)$")
#: A house number before a street with its type word.
NUMBERED_STREET = re.compile(
    rf"\d(?<![\w.,-].)\d{{0,4}}(?:(?:\s(?:bis|ter)|[a-c])?,?\s(?:rue|chemin|bd|boulevard|avenue|av\.|place|impasse|quai|allée|route)\s[\w'’ -]{{3,30}}"
    rf"|[A-Ca-c]?\s(?:[NSEW]\.\s)?(?:[{_U}][{_L}]+\s){{1,3}}(?:Lane|Ln|Court|Ct|Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Way|Close|Terrace|Place|Square|Boulevard|Blvd|Hill|Row|Walk|Crescent)\b\.?)",
    re.S,
)
_DIGIT = re.compile(r"\d")
_DATE = re.compile(r"(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d")
_TYPE = re.compile(rf"(?:{_STREET})\.|C/|calle|Calle|Plaza|plaza|Paseo|paseo|ulica|aleja|osiedle|улица|rue|chemin|bd|avenue|place|Lane|Court|Street|Ave|Road|Rd|weg|gasse|straße|str\.|allee|platz|Weg|Am |An |Im ")
_AFTER_ADDRESS = re.compile(r"(?:/\d+|\s?(?:m|lok)\.\s?\d+)?\s?,\s?(?:(?:Apt|Unit|Flat|Suite|portal|piso|bajo|esc)\b|\d\d-\d{3}|\d{5}|[A-Z]{2} \d{5})|(?:/\d+|\s(?:m|lok)\.\s?\d+)")
#: Words that lead to an address and are no part of it.
NOT_STREET = {"Wohnung", "Adresse", "Adres", "Address", "Raum", "Nr", "Lokal", "Annex", "Anlage", "Part", "Art", "Sec", "Version", "Załącznik", "Annexe", "Anexo", "Clause", "Abs", "Abb", "Tab", "Siehe", "Invoice", "Faktura", "Rechnung", "No"}
#: What introduces an identity number of a person, in small letters.
ID_CUES = ("pesel", "paszport", "dowód", "dowodu", "passport", "insurance", "licence", "license", "ssn", "security", "steuer-id", "steuer", "ausweis", "reisepass", "führerschein", "dni", "nie", "pasaporte", "passeport", "sociale", "permis", "identité", "паспорт", "снилс", "инн", "身份证", "护照", "nif", "curp", "prawo jazdy")
#: What introduces numbers of firms and things, in small letters.
THING_CUES = ("krs", "nip", "regon", "order", "zamówienie", "auftrag", "commande", "pedido", "batch", "job", "invoice", "faktura", "lot", "partii", "los", "ref", "przesyłka", "shipment", "iban", "version", "партии", "form", "formularz", "ip", "nos", "отправление", "#")
#: What introduces a phone number, in small letters.
PHONE_CUES = ("tel", "numerem", "phone", "call", "telefon", "on", "under", "unter", "au", "en", "el", "το", "телефону", "電話は", "电话", "फोन", "هو", "тел", "fax", "mobile", "fon", "0")
FIRM = re.compile(r"[ \n](?:S\.A|Sp\.|sp\.|GmbH|AG\b|Ltd|Inc|Corp|S\.L|S\.A\.R\.L|LLC|KG|& Co|plc|ООО|SARL)")
#: What stands before the name of a firm or a place, in small letters.
FIRM_BEFORE = frozenset(("spółka", "spółki", "firma", "firmy", "majątek", "société", "entreprise", "sociedad", "empresa", "company", "ооо", "зао", "ао", "компания", "firm", "gesellschaft", "of", "in", "w", "à"))
#: What introduces an address, in small letters.
ADDRESS_CUES = {"adres", "adresem", "address", "adresse", "anschrift", "dirección", "direccion", "adresu", "zam", "zamieszkały", "zamieszkała", "mieszka", "lives", "wohnt", "wohnhaft", "vive", "habite", "domicilio", "domicile", "проживает", "адрес", "адресу", "διεύθυνση"}
#: Short words that may lead to an address.
PLACE_BEFORE = {"to", "at", "an", "au", "en", "a", "przy", "in", "w", "na", "по", "на", "calle", "rue"}
#: A type word that only streets have.
STRONG_TYPE = re.compile(rf"(?:^|\s)(?:{_STREET})\.|C/|(?:calle|plaza|paseo|avenida|ulica|aleja|osiedle|улица|проспект|переулок|rue|chemin|boulevard|allée|impasse)\s|(?:straße|strasse|str\.|gasse|allee|platz|weg)\s\d|\s(?:Street|Road|Avenue|Lane|Court|Drive|Crescent|Terrace)\b", re.I)
_CITY_AFTER = re.compile(rf",\s(?:[A-Z]-)?(?:\d[\d -]{{3,6}}\s)?[{_U}][{_L}]+")
#: Common surnames of one character, of two characters, and common Japanese ones.
HAN_SURNAMES = frozenset("王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何林高罗羅郑鄭梁谢謝宋唐许許韩韓冯馮邓鄧曹彭曾肖萧蕭田董袁潘于蒋蔣蔡余杜叶葉程苏蘇魏吕呂丁任沈姚卢盧姜崔钟鍾谭譚陆陸汪范廖石金韦韋贾賈夏付傅方邹鄒熊白孟秦邱江尹薛闫阎段雷侯龙龍史陶黎贺賀顾顧毛郝龚邵万萬钱錢严嚴赖覃洪武莫孔汤常温康施文牛樊葛邢安齐伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季成霍涂苗裴谷曲盛冉翁蓝路游辛靳管柴蒙鲍华喻祁房滕屈饶解牟艾尤时穆司农桑郁卓蒲褚娄戚米车项闵费卞计宫苟骆丘岑屠井景骈桂简连楚沙池隋封隆麦古仇查晏佟冷丛卫瞿栾虞缪")
HAN_DOUBLE = ("欧阳", "歐陽", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "宇文", "长孙", "司徒", "夏侯", "端木", "南宫", "独孤")
JP_SURNAMES = ("佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "渡邊", "山本", "中村", "小林", "加藤", "吉田", "山田", "佐々木", "山口", "松本", "井上", "木村", "清水", "山崎", "池田", "阿部", "橋本", "山下", "森", "石川", "前田", "藤田", "小川", "岡田", "後藤", "長谷川", "石井", "村上", "近藤", "坂本", "遠藤", "青木", "藤井", "西村", "福田", "太田", "三浦", "藤原", "岡本", "松田", "中川", "中野", "原田", "小野", "田村", "竹内", "金子", "和田", "中山", "石田", "上田", "森田", "柴田", "酒井", "工藤", "横山", "宮崎", "宮本", "内田", "高木", "安藤", "谷口", "大野", "丸山", "今井", "藤本", "武田", "村田", "上野", "杉山", "増田", "平野", "大塚", "千葉", "久保", "松井", "野口", "菊地", "新井", "樋口", "桜井", "野村", "木下")
#: Characters that end Japanese given names, and those that end words for roles, firms and papers.
JP_GIVEN_END = frozenset("郎子美馬緒太介也香奈希斗翔樹真恵彦雄夫男之代江乃菜花葉輔佑哉朗織音実里沙咲愛平吾司治一二三志史")
HAN_ROLE_END = frozenset("者長长部課课社员員人会會商店屋所局司院团団方主客們们书書則则份件单表約约")
#: Words before honorifics that are no names.
NOT_HAN = frozenset(("お客", "客", "皆", "皆々", "神", "王", "奥", "貴", "たく", "みな", "お疲れ", "何", "担当者", "お医者", "学生", "先生", "両", "今天", "明天", "昨天", "安全", "方案", "方法", "时间", "时候", "成本", "金额", "文件", "计划", "单位", "经理", "项目", "程序", "费用", "任何", "马上", "高度", "关于", "于是", "应该", "明确", "平均", "许可", "温度", "万元", "常见", "连续", "水平", "包括", "利用", "白色", "黄色", "何时", "严格", "符合", "相关", "总之", "因此", "所有", "公司", "客户", "合同", "申请", "施工", "管理", "全部", "房间", "路上", "车间", "简单", "古代", "游客", "沙发", "宁可", "尚未", "燕子"))
#: What stands before and behind Chinese names inside a sentence.
HAN_BEFORE = re.compile(r"(?:联系|聯繫|通知|转交|交给|委托|询问|感谢|致电|拜访|由|与|和|给|请|致|向|经|让|找|跟|叫|为|是|对|及|被)$")
HAN_AFTER = re.compile(r"先生|女士|小姐|老师|经理|于|在|检查|审|签|退|确认|更正|拒绝|批准|提交|收|同意|负责|表示|认为|要求|填写|修改|通过|完成|参加|住|说|将|已|未|昨|今|明天|曾|和|与|及|的|电话|邮箱|身份证|护照")
#: The same for Japanese: an honorific. A run of kanji may have ノ, ヶ and kana in it.
HONORIFIC = re.compile(r"さん|様|さま|氏|殿|くん|君|ちゃん|先生")
HAN = re.compile(r"[一-鿿]")
_HAN_PARTICLE = re.compile(r"[了的过着这那们个么吗呢吧]")
_HAN_RUN = re.compile(r"[一-鿿]{2,}")
_KANJI_RUN = re.compile(r"(?:[一-鿿々ノヶ]+(?:[ 　]?[一-鿿々ノヶ]+)?(?:[ぁ-ん]{2,4}?|[ァ-ヺー]{2,5})?|(?<![ァ-ヺー])[ァ-ヺー]{2,}|(?<![ぁ-んァ-ヺー一-鿿々])[ぁ-ん]{2,4}?)(?=さん|様|さま|氏|殿|くん|君|ちゃん|先生)")
_ALONE = re.compile(r"(?<![^\n\t,;|\"])[ 　]*([一-鿿々ノヶ]{1,5}[ 　]?[一-鿿々ノヶぁ-んァ-ヺー]{1,5})[ 　]*(?![^\n\t,;|\"])")
LABEL = re.compile(r"\[[A-ZĄĆĘŁŃÓŚŹŻ]+(?:_\d+)?\]|<[A-Z]+(?:_\d+)?>|\*{4}")


@lru_cache(1)
def model() -> dict:
    return json.loads(MODEL.read_text())


_JOIN = re.compile(r"[ \n ]")


def token_score(word: str, lex: dict, ends: dict, memo: dict) -> float:
    """How name-like a capitalised word is, in -1..1: from the lexicon, else from its ending."""
    got = memo.get(word)
    if got is None:
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        parts = word.lower().split("-")
        vals = []
        for w in parts:
            v = lex.get(w)
            if v is None or v < 0.6 and given(w):
                v = prior(w)
            if v is None:
                v = next((ends[w[-n:]] for n in (6, 5, 4, 3) if len(w) > n and w[-n:] in ends), -0.4)
            vals.append(v)
        got = memo[word] = max(vals) if len(vals) > 1 else vals[0]
    return got


def before(text: str, at: int, span: int = 22) -> list[str]:
    """The last words before an offset, in small letters and without signs, nearest first."""
    return [w for x in text[max(0, at - span) : at].lower().replace("\n", " ").split(" ")[::-1] if (w := x.strip("\"'„(,;:.="))]


_CUES = [(k, frozenset(cues), tuple(c for c in cues if len(c) > 4)) for k, cues in enumerate((PHONE_CUES, ID_CUES, THING_CUES))]


@lru_cache(100_000)
def _cues(word: str) -> int:
    """The cue classes of a word as bits: phone, identity number, thing."""
    return sum(1 << k for k, exact, heads in _CUES if word in exact or word.startswith(heads))


def _cue(words: list[str], kind: int, depth: int = 3) -> int:
    """1 for a cue of the kind in the nearest word, 2 and 3 further away, 9 for none."""
    for k, w in enumerate(words[:depth]):
        if _cues(w) >> kind & 1:
            return k + 1
    return 9


def number_features(text: str, a: int, b: int, code: bool) -> list[float]:
    s = text[a:b]
    digits = sum(map(str.isdigit, s))
    w = before(text, a, 34)
    groups = [len(g) for g in re.findall(r"\d+", s)]
    seps = set(c for c in s if not c.isalnum())
    return [
        digits, s.startswith("+"), "(" in s, "-" in seps, " " in seps or "\n" in seps, "." in seps, "/" in seps, len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        sum(c.isalpha() for c in s), _cue(w, 0, 2), _cue(w, 1), _cue(w, 2, 2), s[:2] in ("00", "01", "8-", "03", "02", "04", "09"), "ext" in s or "wew" in s, float(code), text[a - 1 : a] in (",", ";", "\t"), text[b : b + 1] in (",", ";", "\t"),
        bool(re.fullmatch(r"(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}.*|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d.*", s, re.S)), text[a - 2 : a] in ("- ", "• ", "– ", ") ", ", "), text[b : b + 2].strip()[:1] == ")",
    ]


def address_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    after = _AFTER_ADDRESS.match(text, b)
    tail = text[b : b + 40]
    w = before(text, a, 34)
    return [
        bool(_TYPE.search(s)), s[:1].isdigit(), after is not None, bool(re.search(r"\d\d-\d{3}|(?<!\d)\d{5}(?!\d)", tail)), len(s), s.count(" "), next((k + 1 for k, x in enumerate(w[:3]) if x.rstrip(".:") in ADDRESS_CUES), 9),
        int(re.findall(r"\d+", s)[0]) if re.search(r"\d", s) else 0, bool(re.search(r"\d\s?[a-z]?$", s)), text[a - 1 : a] in ("", "\n", '"'), bool(re.match(r"\s?[a-zß]", tail)), a == 0 or text[a - 2 : a].strip()[:1] in (".", "!", "?"), bool(STRONG_TYPE.search(s)), _CITY_AFTER.match(text, after.end() if after else b) is not None, bool(w) and w[0] in PLACE_BEFORE,
    ]


_OPEN = frozenset(",;(")


@lru_cache(MEMO_LIMIT)
def _left_of_name(head: str) -> tuple[bool, float, bool]:
    """What stands before a name: whether the nearest word is a title, how often names follow it, whether it leads to a firm or a place."""
    w = ""
    for x in reversed(head.lower().replace("\n", " ").split(" ")):
        if w := x.strip("\"'„(,;:.="):
            break
    return w in TITLES, model()["before"].get(w, 0.1) if w else 0.2, w in FIRM_BEFORE


@lru_cache(MEMO_LIMIT)
def _right_of_name(tail: str) -> float:
    """How often names stand before the word that begins a tail."""
    return model()["after"].get(_word_after(tail, 0), 0.1)


@lru_cache(MEMO_LIMIT)
def _given_in(name: str) -> float:
    return max(map(given, re.split(r"[ \n-]", name.lower())))


def name_features(text: str, a: int, b: int, scores: list[float], initials: int) -> list[float]:
    s = text[a:b]
    title, before_, firm_before = _left_of_name(text[max(0, a - 24) : a])
    left, right, second = text[a - 1 : a] if a else "", text[b : b + 1], text[b + 1 : b + 2]
    gap = right == " " or right == "\n"
    n = len(scores)
    most, least, mean = (scores[0],) * 3 if n == 1 else (max(scores), min(scores), sum(scores) / n)
    return [
        most, least, mean, n, initials, s.isupper(), title, before_, _right_of_name(text[b : b + 24]),
        gap and FIRM.match(text, b) is not None, not left or left == "\n" or text[max(0, a - 2) : a].strip()[:1] in (".", "!", "?"), right in _OPEN or right.isspace() and second in _OPEN, right == "" or right == "\n", "-" in s, gap and second.isdigit(), left in (",", ";", '"', "\t"),
        gap and second.islower(), firm_before, _given_in(s),
    ]


_AFTER = re.compile(r"[\s,;(]{0,3}([^\s,;()]{1,20})")


def _word_after(text: str, b: int) -> str:
    return m.group(1).lower().strip(".:") if (m := _AFTER.match(text, b)) else ""


def streets(text: str):
    """Spans of street names with house numbers, type words included."""
    for m in NAMED_STREET.finditer(text):
        a, b = m.span()
        if t := STREET_TYPE.search(text, max(0, a - 30), a):
            a = t.start()
        while (w := re.match(r"(\w+)\s", text[a:b])) and w.group(1) in NOT_STREET:
            a += w.end()
        if re.search(r"[^\W\d]", text[a:b]) and not text.startswith("nr", a):
            yield a, b
    for m in NUMBERED_STREET.finditer(text):
        yield m.span()


def scored_words(text: str, lex: dict, ends: dict, memo: dict) -> list[tuple[int, int, str, float]]:
    """Words with a capital and how name-like they are."""
    return [(*m.span(), w := m.group(), token_score(w, lex, ends, memo)) for m in WORD.finditer(text)]


def name_spans(text: str, words: list[tuple[int, int, str, float]], floor: float = -0.15) -> list[tuple[int, int, list[float], int]]:
    """Runs of name-like words, with initials beside them: ``(start, end, scores, initials)``."""
    out: list[tuple[int, int, list[float], int]] = []
    lex = model()["lex"]
    for a, b, w, s in words:
        if s < floor and (text[a - 1 : a] == "\n" and w.lower() in lex or not (s > -0.45 and out and out[-1][1] == a - 1 and len(out[-1][2]) == 1 and out[-1][2][0] > 0.3)):
            continue
        if out:
            pa_, pb, sc, ini = out[-1]
            gap = text[pb:a]
            if gap in (" ", "\n") and FIRM.match(text, pb):
                continue  # the form of a firm is no part of the name before it
            if len(sc) < 3 and (gap in (" ", "\n") or re.fullmatch(rf",[ \n]|[ \n][{_U}]\.[ \n]", gap)) and (gap[0] != "," or len(sc) == 1 and max(sc) > 0.0 and s > 0.3 and not (text[pa_ - 5 : pa_].endswith(("und ", "oraz ", "and ")))):
                out[-1] = (pa_, b, [*sc, s], ini + (gap.strip(" \n,") != ""))
                continue
        ini = 0
        while left := _LEFT_INITIAL.search(text, max(0, a - 4), a):
            a, ini = left.start(), ini + 1
        out.append((a, b, [s], ini))
    done = []
    for a, b, sc, ini in out:
        if ini and len(sc) > 1 and sc[0] > 0.3 and text[a : a + 3] in ("M. ", "D. ", "P. ", "M.\n", "P.\n"):
            a, ini = a + 3, ini - 1  # before a given name and a surname these are titles
        if not ini and (r := _RIGHT_INITIAL.match(text, b)) and len(sc) == 1:
            b, ini = r.end(), 1
        done.append((a, b, sc, ini))
    return done


def han_score(run: str, m: dict) -> float:
    """How name-like a run of Han characters is: -1 for an ordinary word, 0 for an unknown one, up to 1 for a known surname and given name."""
    han = m.get("han", {})
    if run in han.get("words", ()) or run in NOT_HAN:
        return -1.0
    run = run.replace(" ", "").replace("　", "")
    best = 0.0
    for n in range(1, min(4, len(run))):
        a, b = run[:n], run[n:]
        learnt, given = a in han.get("sur", ()), b in han.get("given", ())
        known = learnt or n == 1 and a in HAN_SURNAMES and len(b) <= 2 or n == 2 and (a in HAN_DOUBLE and len(b) <= 2 or a in JP_SURNAMES) or n == 3 and a in JP_SURNAMES
        best = max(best, 1.0 if known and given else 0.6 if known else 0.5 if given else 0.0)
    return best


def han_names(text: str):
    """Spans of Han and Japanese name candidates ``(start, end, honorific)``: before an honorific, alone, or by surname and context."""
    seen = set()
    for m in _KANJI_RUN.finditer(text):
        a, b = m.span()
        starts = [a, *(i for i in range(a + 1, b - 1) if text[i : i + 2] in JP_SURNAMES or text[i : i + 3] in JP_SURNAMES)]
        for i in starts:
            if (i, b) not in seen:
                seen.add((i, b))
                yield i, b, True
    for m in _ALONE.finditer(text):
        if m.span(1) not in seen and not HONORIFIC.search(m.group(1)):
            seen.add(m.span(1))
            yield *m.span(1), False
    for m in _HAN_RUN.finditer(text):
        a, b = m.span()
        if re.match(r"[ぁ-んァ-ヺー々]", text[b : b + 1]) or re.match(r"[ぁ-んァ-ヺー々]", text[a - 1 : a] if a else ""):
            continue
        for i in range(a, b - 1):
            led = i == a or HAN_BEFORE.search(text, max(a, i - 2), i) is not None
            double = text[i : i + 2] in HAN_DOUBLE
            if not (led or double or text[i] in HAN_SURNAMES):
                continue
            for n in (4, 3, 2):
                e = i + n
                ends = e == b or HAN_AFTER.match(text, e, b) is not None
                if e <= b and ends and (led or n <= (4 if double else 3)) and (i, e) not in seen:
                    seen.add((i, e))
                    yield i, e, False


def han_features(text: str, a: int, b: int, score: float, honorific: bool) -> list[float]:
    """Score, honorific, alone, signed, address behind, length, two endings, cue before, mark behind, word behind, start of a run, cue or surname inside."""
    line = text[text.rfind("\n", 0, a) + 1 : a].strip()
    alone = not line and text[b : b + 1] in ("", "\n") or text[a - 1 : a] in ("\t", ",", ";", "|") and text[b : b + 1] in ("\t", ",", ";", "|", "\n", "")
    tail = text[b : b + 40].lstrip()
    signed = text[max(0, a - 5) : a].rstrip(" \n").endswith("--")
    return [score, float(honorific), float(alone), float(signed), "@" in tail.split("\n", 1)[0] or "(at)" in tail.split("\n", 1)[0], b - a, text[b - 1] in HAN_ROLE_END, text[b - 1] in JP_GIVEN_END, HAN_BEFORE.search(text, max(0, a - 2), a) is not None, bool(re.match(r"[，,]|于|先生|女士|小姐", text[b : b + 2])), HAN_AFTER.match(text, b) is not None, a == 0 or not HAN.match(text[a - 1]), 2.0 if not score and any(text[k : k + 2] in JP_SURNAMES for k in range(a + 1, b - 2)) else float(bool(_HAN_PARTICLE.search(text, a + 1, b)) or any(HAN_AFTER.match(text, k, b) or HAN_BEFORE.search(text, a, k) for k in range(a + 1, b)))]


def low_spans(text: str, words: list[tuple[int, int, str, float]], taken: list, lex: dict) -> list[tuple[int, int, list[float], int]]:
    """Words with a capital that ``name_spans`` leaves: runs of words that the lexicon lacks, other words one by one."""
    out: list[tuple[int, int, list[float], int]] = []
    joins, k, n = False, 0, len(taken)
    for a, b, w, s in words:
        while k < n and taken[k][1] <= a:
            k += 1
        if k < n and taken[k][0] < b or w[0] in "SGALICKО" and a and FIRM.match(text, a - 1):
            joins = False
            continue
        unknown = w.lower() not in lex
        if joins and unknown and len(out[-1][2]) < 3 and text[out[-1][1] : a] in (" ", "\n"):
            out[-1] = (out[-1][0], b, [*out[-1][2], s], 0)
        else:
            out.append((a, b, [s], 0))
        joins = unknown
    return out


_CASELESS = re.compile("[\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f]")
_INDIC = r"[\u0900-\u0963\u0970-\u097f]+"
_ARABIC = r"[\u0621-\u064a]+"
_THAI = r"[\u0e01-\u0e3a\u0e40-\u0e4e]{2,14}"
_AFTER_HONORIFIC = re.compile(rf"(?<!\S)(?:{'|'.join(sorted(HONORIFIC_BEFORE, key=len, reverse=True))})(?:(?<=[\u0e00-\u0e7f])\s?|\s)((?:{_INDIC}|{_ARABIC})(?:\s(?:{_INDIC}|{_ARABIC}))?|{_THAI}\s{_THAI}(?!\S))")
_BY_GIVEN = re.compile(rf"(?<![\w\u0900-\u097f\u0e00-\u0e7f])(?:{'|'.join(sorted(GIVEN_CASELESS, key=len, reverse=True))})(?![\w\u0900-\u097f\u0e00-\u0e7f])(?:\s(?:{_INDIC}|{_ARABIC}|{_THAI}))?")
#: Words behind a name or an honorific that are no part of a name.
NOT_SURNAME = frozenset("से ने को का की के में पर और साहब महोदय في من على إلى عن و مع قال المدير الكريم ครับ ค่ะ และ ที่ ได้ เป็น".split())


def caseless_names(text: str):
    """Spans of names in scripts without capitals: behind a form of address, or begun by a common given name."""
    for m in _AFTER_HONORIFIC.finditer(text):
        yield from _trimmed(text, *m.span(1))
    for m in _BY_GIVEN.finditer(text):
        yield from _trimmed(text, *m.span())


def _trimmed(text: str, a: int, b: int):
    words = text[a:b].split()
    while words and words[-1] in NOT_SURNAME:
        words.pop()
    if words and words[0] not in NOT_SURNAME:
        yield a, a + len(text[a:b][: text[a:b].find(words[-1]) + len(words[-1])])


def candidates(text: str, lex: dict, ends: dict, memo: dict):
    """Spans ``(kind, start, end, features)`` of every generator."""
    if "@" in text or _AT.search(text):
        for m in EMAIL.finditer(text):
            s = m.group()
            yield "email", *m.span(), [len(s), s.count("@"), s.count("."), "(" in s or "[" in s, bool(re.search(r"\d", s)), text[m.start() - 1 : m.start()] in ("", " ", "\n", ",", ";", "(", "=", ":", '"'), s[-1].isalpha(), (" @" in s) != ("@ " in s), s[0].isdigit() and re.match(r"[\d.]+\s?@", s) is not None, _NO_MAIL.match(text, m.end()) is not None, _DECORATED.search(text, max(0, m.start() - 8), m.start()) is not None]
    if _DIGIT.search(text):
        seen = set()
        for rx, code in ((NUMBER, False), (CODE, True)) if _CODE_GATE.search(text) else ((NUMBER, False),):
            for m in rx.finditer(text):
                a, b = m.span()
                if (tail := _TAIL.search(text, a, b)) and tail.start() > a + 5:
                    b = tail.start()
                while text[b - 1] == ")" and text.count("(", a, b) < text.count(")", a, b):
                    b -= 1
                if (a, b) in seen or b - a < 7 or _DATE.match(text, a, b) or not code and sum(map(str.isdigit, text[a:b])) < 7:
                    continue
                seen.add((a, b))
                x = number_features(text, a, b, code)
                if not code:
                    yield "phone", a, b, x
                yield "id_number", a, b, x
        for a, b in streets(text):
            yield "address", a, b, address_features(text, a, b)
    words = scored_words(text, lex, ends, memo)
    spans = name_spans(text, words)
    for a, b, sc, ini in spans + low_spans(text, words, spans, lex):
        yield "name", a, b, name_features(text, a, b, sc, ini)
    if _CASELESS.search(text):
        for a, b in caseless_names(text):
            yield "name", a, b, name_features(text, a, b, [0.75] * (1 + text.count(" ", a, b)), 0)
    if HAN.search(text) or "さん" in text or "さま" in text:
        for a, b, honorific in han_names(text):
            yield "han", a, b, han_features(text, a, b, han_score(text[a:b], model()), honorific)


def mentions(text: str, memo: dict | None = None, damaged: bool = False) -> list[tuple[str, int, int]]:
    """Selected mentions ``(kind, start, end)`` of a text, in order. ``damaged``: it may be decoded wrongly."""
    if not text:
        return []
    if damaged and not text.isascii():
        restored, back = repair_mapped(text)
        if restored != text:
            got = mentions(restored, memo)
            return got if back is None else [(k, back[a], back[b - 1] + 1) for k, a, b in got]
    m = model()
    memo = {} if memo is None else memo
    read, src = unify_mapped(text)
    tokens, verdicts = memo.setdefault("tokens", {}), memo.setdefault("verdicts", {})
    if len(verdicts) > MEMO_LIMIT:
        verdicts.clear()
    got = []
    for kind, a, b, x in candidates(read, m["lex"], m["ends"], tokens):
        key = (kind, *x)
        p = verdicts.get(key)
        if p is None:
            p = verdicts[key] = boosting.score(m["trees"][kind], x) - m["threshold"][kind]
        if p > 0:
            kind = "name" if kind == "han" else kind
            got.append((KINDS.index(kind), -p if kind == "name" else a - b, a, b, kind))
    got.sort()
    taken: list[tuple[int, int, str]] = []
    labels = [x.span() for x in LABEL.finditer(read)] if "[" in read or "<" in read or "****" in read else []
    for _, _, a, b, kind in got:
        if all(b <= c or a >= d for c, d, _ in taken) and all(b <= c or a >= d for c, d in labels):
            taken.append((a, b, kind))
    taken.sort()
    if src is None:
        return [(k, a, b) for a, b, k in taken]
    return [(k, src[a], src[b - 1] + 1) for a, b, k in taken]


_TYPE_PA = pa.list_(pa.struct([("kind", pa.string()), ("start_off", pa.int32()), ("end_off", pa.int32())]))
DDL = "array<struct<kind:string,start_off:int,end_off:int>>"


def find_mentions(df: DataFrame, text: str = "text", keep_text: bool = False, src: str = "src") -> DataFrame:
    """Rows of ``df`` with ``mentions`` in place of the text (or beside it). Plain texts may be decoded wrongly."""
    parts = []
    for part, damaged in ((df.filter(F.col(src) != "text_doc"), False), (df.filter(F.col(src) == "text_doc"), True)):

        def run(texts, damaged=damaged, memo={}):  # noqa: B006
            return pa.array([[{"kind": k, "start_off": a, "end_off": b} for k, a, b in mentions(t, memo, damaged)] if t else [] for t in texts], _TYPE_PA)

        parts.append(add_column(part, "mentions", DDL, run, text, keep_text))
    return parts[0].unionByName(parts[1])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The text with a placeholder ``[KIND]`` for each mention, everything else as it was, and the number of them."""
    got = find_mentions(df, text, keep_text=True)
    cut = F.aggregate(
        "mentions",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, m: F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, m.start_off - acc["at"]), F.lit("["), F.upper(m.kind), F.lit("]")).alias("out"), m.end_off.alias("at")),
    )
    kept = [c for c in df.columns if c != text]
    return got.withColumn("_c", cut).select(*kept, F.concat("_c.out", F.expr(f"substring({text}, _c.at + 1)")).alias(text), F.size("mentions").alias("redactions"))


def mention_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct ``(src, doc_id, id, kind, start_off)``; redelivered items count once."""
    got = find_mentions(df, text).filter(F.size("mentions") > 0).dropDuplicates(KEY)
    return got.select(*KEY, F.explode("mentions").alias("m")).select(*KEY, "m.kind", "m.start_off")
