"""Problem 8: personal information in free text.

Mentions are found per line by shape and by the words around them: email
addresses (also spelled-out ones), phone numbers, identity numbers behind their
labels, street addresses by the form of the country, and personal names, which
are a given and a family name side by side.  A name is told by a lexicon, which
may be incomplete, or by a context that only a person's name stands in: a title,
a form of address, a role, a preposition or verb that takes a person, a label, a
salutation or a signature.  A title alone, a lone family name and an institution
are none.  Dates are personal where words of birth stand before them.

``redact`` replaces each mention by a typed placeholder.  Phone and identity
numbers and dates of birth are permuted within their format by a keyed Feistel
network, so equal values have equal pseudonyms in every document and format.  An
identity number is validated first: one whose check digit holds keeps a holding
one, and its date of birth stays a date; of any other all digits are permuted.
Other mentions get a keyed tag of 96 bits.  The rest of the text is unchanged.
The key must be given; whoever has it can undo the permutation of numbers.

Null texts give no mentions and stay null.  Texts in decomposed form are matched
in composed form and reported at the offsets of the text as it is.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import os
import re
import secrets
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.session import table

LEAST_KEY, TAG_BYTES = 16, 12
MOST_NAMES = 1_000_000
KINDS = ("email", "phone", "id_number", "address", "person", "date")

# ---- emails
_AT = r"(?:@|＠| @ | ?[\[(]at[\])] ?)"
_DOT = r"(?:\.| ?[\[(]dot[\])] ?)"
_EMAIL = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+", re.I)

# ---- identity numbers: fixed labels of such numbers in the languages of the corpus
_ID_LABEL = (
    r"SSN(?: is)?|[Pp]assport(?: no\.?)?|identity number|ID number|Steuer-?ID|Ausweisnr\.?|Personalausweis|N[°º] de sécurité sociale|Passeport|DNI|NIE|"
    r"Pasaporte|Паспорт|ИНН|СНИЛС|(?:주민|외국인|여권)?등록번호(?:는)?|여권번호(?:는)?|個人番号|旅券番号|マイナンバー|身份证号码?|护照号码?"
)
_ID = re.compile(rf"(?:{_ID_LABEL})\s*[:：#]?\s*((?:[A-Z]{{0,3}}\d[\dA-Z]*|[A-Z]\d{{2}}[A-Z]\d+)(?:(?: ?[-–] ?| )\d+[A-Z]?(?![a-z\w]))*)(?![\w])?")

# ---- phones
_CC = r"[+＋]\d{1,3}[ .\-]?(?:[(（]\d{1,4}[)）][ .\-]?)?\d{1,5}(?:[ .\-]\d{2,5}){1,5}|[+＋]\d{9,14}"
_LOCAL = (
    r"[(（]\d{2,4}[)）] ?\d{3,8}(?:[ .\-]\d{2,5}){0,3}|[0０]\d{1,2}\) ?\d{3,4}[ .\-]?\d{4}|8[ \-]?[( ]\d{3}[) ] ?\d{3}[ \-]\d{2}[ \-]\d{2}|"
    r"\d{1,5}(?:[ .\-/]\d{2,8}){1,5}|\d{9,12}"
)
_PHONE_CUE = r"(?:(?:(?<![A-Za-zА-я])(?:[Tt]el|TEL|[Tt]él|[Тт]ел|[Pp]hone|[Cc]all|answers|on|or|oder|ou|o|или|[Tt]elefon|[Tt]eléfono|[Tt]éléphone)|연락처|전화|또는|または|電話|致电|电话)\.?[:：]?\s?)"
_PHONE = re.compile(rf"(?<![A-Za-z0-9_$^{{])(?:{_CC})(?![\d\-])|{_PHONE_CUE}({_LOCAL})(?![\d\-/])|(?<![A-Za-z0-9_$(（])([(（][0０]\d{{1,3}}[)）] ?\d{{3,4}}[ \-]?\d{{4}}|\(\d{{3}}\) \d{{3}}-\d{{4}})(?![\d\-])")

# ---- dates of birth
# Months in the languages whose dates name them.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split(),
}
_MONTH_NAMES = {name.casefold(): (names, i) for names in MONTHS.values() for i, name in enumerate(names)}
_MONTH_WORD = "|".join(sorted({name for names in MONTHS.values() for name in names}, key=len, reverse=True))
_BORN = (
    r"\b[Bb]orn(?: on)?|[Dd]ate of birth|DOB|[Bb]irthday|[Gg]eboren(?: am)?|geb\.(?: am)?|Geburtsdatum|[Nn]ée? le|[Dd]ate de naissance|[Nn]acid[oa](?: el)?|[Ff]echa de nacimiento|"
    r"[Рр]одил(?:ся|ась)|[Дд]ата рождения|생년월일(?:은|는)?|출생일?|生年月日|誕生日|出生日期|出生于|生于"
)
_BORN_HINTS = ("orn", "irth", "DOB", "ebor", "geb.", "Geburt", "né", "naissance", "acid", "nacimiento", "оди", "рожд", "생년", "출생", "生")
_DATE = (
    r"(?P<d1>\d{1,2})(?P<sep>[./\-])(?P<m1>\d{1,2})(?P=sep)(?P<y1>\d{4})|(?P<y2>\d{4})(?P<sep2>[./\-]) ?(?P<m2>\d{1,2})(?P=sep2) ?(?P<d2>\d{1,2})|"
    r"(?P<y3>\d{4})[年년] ?(?P<m3>\d{1,2})[月월] ?(?P<d3>\d{1,2})[日일]|"
    rf"(?P<d4>\d{{1,2}})\.? (?:de )?(?P<m4>{_MONTH_WORD}),? (?:de )?(?P<y4>\d{{4}})|(?P<m5>{_MONTH_WORD}) (?P<d5>\d{{1,2}}), (?P<y5>\d{{4}})"
)
_BIRTH = re.compile(rf"(?:{_BORN})\s?[:：]?\s?((?:{_DATE}))(?!\d)")
_ONE_DATE = re.compile(_DATE)

# ---- addresses
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’\-]*"
_ADDRESS = [
    re.compile(p)
    for p in (
        # English
        rf"(?:(?:Apt|Flat|Unit|Suite)\.? \w{{1,4}}, )?(?:P\.? ?O\.? Box \d+|\d{{1,5}}[A-Za-z]? (?:(?:{_CAP}|St\.)\s){{1,4}}(?:Street|Avenue|Road|Drive|Lane|Way|Court|Place|Square|Terrace|Row|Close|Boulevard|Crescent|(?:St|Ave|Rd|Dr|Ln|Ct|Blvd)\b\.?)(?:,? (?:Apt|Flat|Unit|Suite)\.? \w{{1,4}})?)(?:, {_CAP})?(?:,? (?:[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}))?",
        # German
        rf"(?:Am|An der|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den) {_CAP} \d{{1,4}} ?[a-z]?, (?:(?:D-)?\d{{5}} )?{_CAP}|(?:(?:(?:Alte[rns]?|Neue[rns]?|Große|Kleine|Hohe) )?{_CAP[:-1]}*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|ufer|damm|steig|markt|stieg|pfad)|(?:Alte|Neue) {_CAP}) \d{{1,4}} ?[a-z]?\b(?:, (?:D-)?\d{{5}} {_CAP}|, {_CAP})?",
        # French
        rf"\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|bd\.?|boulevard|impasse|place|allée|chemin|quai|cours|route|square|passage) (?:(?:des?|du|de la|de l['’]|d['’]) ?)?{_CAP}(?: {_CAP})*(?:, (?:\d{{5}} )?{_CAP})?",
        # Spanish
        rf"(?:C/|Calle|Avda\.?|Av\.|Avenida|Plaza|Pza\.|Paseo|Camino|Ronda|Travesía) (?:(?:de la|de los|de las|del|de) )?{_CAP}(?: {_CAP})*,? \d{{1,4}}(?:, \d{{1,2}}\.?[ºª](?: ?[A-Z]\b)?)?(?:, (?:\d{{5}} )?{_CAP})?",
        # Russian
        r"(?:\d{6}, )?(?:г\. ?[А-ЯЁ][\w\-]*, )?(?:ул\.|пр\.|просп\.|пер\.|пл\.|наб\.|бул\.|ш\.) ?[А-ЯЁ][\w\-]*(?: [а-яё]+)?, (?:д\. ?)?\d+\w?(?:, (?:корп|стр|кв)\. ?\d+)*(?:, (?:\d{6} )?(?:г\. ?)?[А-ЯЁ][\w\-]*)?",
        # Korean: postal code or town or a mark of the address is required
        r"(?:[(（]\d{5}[)）] ?)?(?:[가-힣]+(?:도|특별시|광역시) )?[가-힣]{2,}[시군] (?:[가-힣]+[구읍면] )?[가-힣]+(?:대로|로|길)(?: ?\d+번길)? \d+(?:-\d+)?(?:, ?(?:\d+동 )?(?:지하 )?\d+층(?: \d+호)?|, ?\d+동 \d+호)?",
        # Japanese
        r"〒?(?:\d{3}[-－‐]\d{4} ?)?(?:(?<=\d )|(?<=[^ァ-ヶー一-龥々\d]))(?:[ァ-ヶー一-龥々]+?[都道府県])?[ァ-ヶー一-龥々]+?[市区町村郡][ァ-ヶー一-龥々]*?(?:\d+丁目(?:\d+番(?:地)?(?:\d+号?)?|\d+(?:-\d+)*)?|\d+番地?(?:\d+号?)?|\d+-\d+(?:-\d+)?)(?:号)?",
        # Chinese
        r"(?:(?<=寄至)|(?<=寄到)|(?<=寄往)|(?<=地址[：:是为])|(?<=住在)|(?<=住址[：:]))(?:\d{6} ?)?(?:[一-龥]{1,8}省)?[一-龥]{1,10}?市(?:[一-龥]{1,8}区)?[一-龥]{1,8}(?:路|街|巷|道|胡同)\d+号(?:\d+(?:单元|栋|幢|号楼))*(?:\d+室)?",
    )
]
_ADDRESS_HINT = (
    re.compile(r"Box|St\b|Street|Ave|R[od]|Drive|Lane|Way|Court|Place|Square|Terrace|Row|Close|B(?:oul|lv)|Crescent|Ln|Ct|Dr\b"),
    re.compile(r"(?:Am|An|Auf|Im|In|Zum|Zur|Unter) |(?:stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|ring|ufer|damm|stei?g|stieg|markt|pfad) \d|Alte|Neue"),
    re.compile(r" (?:rue|avenue|av\.|bd\.?|boulevard|impasse|place|allée|chemin|quai|cours|route|square|passage) "),
    re.compile(r"C/|Calle|Avda|Av|Plaza|Pza|Paseo|Camino|Ronda|Travesía"),
    re.compile(r"(?:ул|пр|просп|пер|пл|наб|бул|ш)\."),
    re.compile(r"[시군] "),
    re.compile(r"\d(?:丁目|番|-)"),
    re.compile(r"寄|址|住在"),
)

# ---- persons
# Contexts are words that stand before or after any person's name in a language:
# titles, forms of address, words for people's roles, prepositions and verbs that
# take a person; and the shapes of labels, salutations and signatures.
_UP = r"A-ZÀ-ÖØ-ÞА-ЯЁ"
_PART = rf"(?:[Dd]['’])?[{_UP}][\w'’\-]+"
_WESTERN = rf"(?:{_PART}, (?:{_PART}|[{_UP}]\.)(?: [{_UP}]\.)?|(?:{_PART}|[{_UP}]\.)(?: [{_UP}]\.)? {_PART})"
# Titles and forms of address.
_TITLE = (
    "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Dame|Rev|Herrn?|Frau|Fräulein|MM?|Mme|Mlle|Monsieur|Madame|Mademoiselle|Sra?|Srta|[Ss]eñora?|[Ss]eñorita|D|Dña|[Dd]on|[Dd]oña|"
    "г-н|г-жа|[Гг]осподин|[Гг]оспожа|[Дд]октор|[Пп]рофессор"
)
_DEAR = "Dear|Hello|Hi|Lieber?|geehrte[rs]?|Hallo|Cher|Chère|Bonjour|Estimad[oa]|Querid[oa]|Hola|Уважаем(?:ый|ая)|Дорог(?:ой|ая)|Здравствуйте"
# Words for roles that a name may follow.
_ROLE = (
    "volunteer|transcriber|translator|proofreader|teacher|author|editor|publisher|librarian|owner|holder|applicant|customer|client|patient|student|pupil|witness|member|"
    "colleague|director|manager|secretary|president|chair|reader|sender|recipient|neighbou?r|friend|doctor|lawyer|nurse|musician|"
    "Lehrer(?:in)?|Autor(?:in)?|Übersetzer(?:in)?|Schüler(?:in)?|Student(?:in)?|Kund(?:e|in)|Patient(?:in)?|Inhaber(?:in)?|Kolleg(?:e|in)|Leiter(?:in)?|Mitglied|Empfänger(?:in)?|"
    "bénévole|transcripteur|transcriptrice|professeure?|auteure?|élève|étudiante?|cliente?|patiente?|titulaire|collègue|directeur|directrice|membre|destinataire|"
    "voluntari[oa]|transcriptora?|profesora?|autora?|alumn[oa]|estudiante|paciente|titular|colega|directora?|miembro|destinatari[oa]|"
    "волонт[её]р|переписчик|переводчик|учитель(?:ница)?|автор|редактор|ученик|ученица|студент(?:ка)?|клиент(?:ка)?|пациент(?:ка)?|владел(?:ец|ица)|коллега|директор|получатель|отправитель"
)
_TAKES = (
    "to|for|from|by|with|and|or|of|thank|thanks|contact|ask|name|named|called|met|meeting|see|via|"
    "an|auf|von|vom|für|mit|durch|bei|und|oder|Namen?|namens|"
    "à|au|de|par|pour|avec|chez|et|ou|nommée?|remercions|"
    "a|por|para|con|y|o|nombre|llamad[oa]|"
    "от|для|к|у|и|или|имя|имени|благодарим"
)
_BEFORE = re.compile(rf"{_DEAR}|{_TITLE}|{_ROLE}|{_TAKES}")
_TITLED, _IN_ROLE = re.compile(_TITLE), re.compile(_ROLE)
_LEFT_WORD = re.compile(r"([^\W\d_](?:[^\W\d_]|-)*)([.,]?) $")
_LEFT_LABEL = re.compile(r"\w\s?: ?$")
_LEFT_GREETING = re.compile(r"(?:^\W*|[.!?…] +)(?:[^\W\d_]+ ){0,3}[^\W\d_]+, $")
_LINE_END = re.compile(r"\W*$")
_VOCATIVE = re.compile(r"\s*$|, (?=[a-zà-ÿа-яё])")
# What only people do.
_DOES = (
    "asked|asks|lives|lived|said|says|wrote|writes|called|calls|thinks|told|answered|replied|was born|works|read|signed|"
    "wohnt|lebt|sagte?|schrieb|schreibt|bat|bittet|fragte|arbeitet|unterschrieb|habite|vit|dit|écrit|écrivit|demande|demanda|travaille|a signé|"
    "vive|dijo|dice|escribió|escribe|pidió|pide|trabaja|firmó|живёт|живет|проживает|сказала?|написала?|попросила?|просит|работает|подписала?"
)
_RIGHT_VERB = re.compile(rf" (?:{_DOES})\b")
_CAPITAL_PAIR = re.compile(rf"(?<![\w.'’\-])(?=({_WESTERN})(?![\w]))[\w'’]")
# Heads of names of institutions and places, and first words that begin no person's name.
_INSTITUTION = re.compile(
    r"[ \-](?:Street|School|Foundation|Institute|Museum|Hall|Society|Prize|College|Stiftung|Library|Road|Avenue|Bridge|University|Hospital|Company|Press|Park|Square|Station|Club|Centre|Center|Award|Church|"
    r"River|Lake|Mountain|Valley|County|Verlag|Schule|Museumstr|Preis|Gesellschaft|Universität|Verein)\b"
)
_NO_NAME = re.compile(
    r"(?:.*[ ,])?(?:(?:En|De|Con|Por|Para|Desde|Sobre|Según|Dans|Sur|Chez|Avec|Après|Avant|Depuis|Sous|Selon|Bei|Mit|Nach|Vor|Seit|Aus|Von|Über|Unter|Laut|Notes|Notas|Notizen|На|По|От|Из|Для|После|До|Около|"
    r"The|This|That|These|Those|An|And|But|When|Where|While|After|Before|In|On|At|To|For|From|With|By|Of|It|He|She|We|They|You|My|Your|His|Her|Our|Their|Its|Mein|Meine|Mon|Ma|Mes|Mi|Mis|Please|New|Old|North|South|East|West|Great|Upper|Lower|Mount|Lake|Port|Fort|"
    r"Saint|San|Santa|Los|Las|Chapter|Line|Table|Page|Figure|Item|Note|Section|Box|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|June|July|August|"
    rf"September|October|November|December|{_TITLE}|Der|Die|Das|Ein|Eine|Am|Im|Alte[rns]?|Neue[rns]?|Stadt|Kapitel|Zeile|Seite|Le|La|Les|Un|Une|El|Una|Ville|Rue|Calle|Plaza|Chapitre|Capítulo|"
    r"Глава|Город|Улица|Street|School|Foundation|Institute|Museum|Hall|Society|Prize|College|Library|Road|Avenue|University)|(?:St|Apt|Flat|Unit|Suite|Tel|Phone|Email|Avda|Cap)\.?)(?:[ ,].*|$)"
)
# Labels of a person's name, and what follows a name, in Korean, Japanese and Chinese.
_KO_ROLES = "담당자?|점역사|점역자|교정자|신청인|신청자|받는 (?:사람|이|분)|보내는 (?:사람|이|분)|작성자|저자|옮긴이|지은이|대표자?|예금주|수신|발신|환자|고객|학생|보호자|연락처|주소로|앞으로"
_KO_AFTER = "드림|올림|님|씨|선생|귀하|여사|박사|교수"
_KO_NAME = r"(?:[가-힣]{1,2} )?[가-힣]{2,5}?"
_KO_LABEL = re.compile(rf"(?:(?:{_KO_ROLES}|성명|이름) ?[:：] ?|(?:성명|이름) )({_KO_NAME})(?= ?(?:{_KO_AFTER})|[ \t]*$|[,.])|(?:{_KO_ROLES}) ({_KO_NAME})(?= ?(?:{_KO_AFTER}))")
_KO_HONORED = re.compile(r"(?:(?<=^)|(?<=[\s.!?”’)]))((?:[가-힣]{1,2} )?[가-힣]{2,5}?)(?= (?:씨(?:[가는를의도께와]|에게)?|귀하|여사|선생님(?:[께이은을의과]|에게)?)(?:[ ,.]|$))")
_JA_LABEL = re.compile(r"(?:点訳者|翻訳者|校正者|氏名|お?名前|担当者?|著者|作者|代表者?|責任者|差出人|宛名|受取人|患者名)(?:[：:]\s?|(?<=[名者]))([一-龥ヶ々]{1,4} ?[ぁ-ん一-龥々ァ-ヶー]{1,5}?)(?=$|[。、\s）])", re.M)
_JA_HONORED = re.compile(r"(?:(?<=^)|(?<=[。！？」…\s)）\d号目地室]の)|(?<=[。！？」…、\s)）]))([一-龥ヶ々]{2,4} ?[ぁ-ん一-龥々]{2,5}?)(?=様|さん|氏|殿)", re.M)
_ZH_LABEL = re.compile(r"(?:(?:译员|译者|姓名|名字|联系人|收件人|寄件人|负责人|作者|编辑|校对员?|患者|客户)[：:]\s?|姓名|名字)([一-龥]{2,4})(?=$|[，。；、\s]|[^一-龥])", re.M)
_ZH_HONORED = re.compile(r"(?:(?<=^)|(?<=[。！？”…\s）室号，：；、]))(?:([一-龥]{3,4})(?=(?:老师|先生|女士|小姐|教授|博士)(?![的们]))|([一-龥]{3,4})(?=收(?:[。，]|$)))", re.M)
_ZH_COMPOUND = frozenset("欧阳 司马 上官 诸葛 皇甫 令狐 夏侯 慕容 东方 公孙 尉迟 长孙 亓官 司徒 宇文 独孤 南宫 西门 端木 申屠 轩辕 钟离 闻人 淳于 澹台 濮阳 呼延 拓跋 百里 第五".split())
_ZH_NO_NAME = re.compile("[的了在是那这某位名个和与或把被让给我你他她它们从向将就都也很最]")


class Lexicon:
    """Known given and family name parts, in folded form."""

    def __init__(self, rows) -> None:
        self.given = {p.casefold() for p, k in rows if p and k == "given"}
        self.family = {p.casefold() for p, k in rows if p and k == "family"}
        self.compound = {p for p in self.family if len(p) > 1}
        cjk = lambda p: re.fullmatch(r"[ぁ-んァ-ヶ一-龥々가-힣]+", p)
        family = sorted((p for p in self.family if cjk(p)), key=len, reverse=True)
        given = sorted((p for p in self.given if cjk(p)), key=len, reverse=True)
        # Both parts known, side by side, where no longer word swallows them.
        self.eastern = re.compile(rf"(?<![가-힣一-龥々])(?:{'|'.join(map(re.escape, family))}) ?(?:{'|'.join(map(re.escape, given))})(?=$|[^가-힣ぁ-ん一-龥々]| |さん|様|氏|님|씨|老师|收)") if family and given else None

    def known_pair(self, text: str) -> bool:
        """A given and a family name of the lexicon, in either order."""
        parts = [p.casefold() for p in re.split(r",? (?:\S\. )?", text)]
        if len(parts) != 2:
            return False
        a, b = parts
        return (a in self.given and b in self.family) or (b in self.given and a in self.family)


@functools.lru_cache(50_000)
def _takes_name(word: str, mark: str = "") -> bool:
    """Whether a name may follow the word; after a period it must be a title, after a comma a role."""
    return bool((_TITLED if mark == "." else _IN_ROLE if mark == "," else _BEFORE).fullmatch(word))


def _in_context(line: str, a: int, b: int) -> bool:
    """Whether what stands around the capital pair at ``a`` to ``b`` stands around persons' names."""
    left = line[max(0, a - 80) : a]
    word = _LEFT_WORD.search(left)
    if word and _takes_name(*word.groups()):
        return True
    if not left.strip():
        return bool(_VOCATIVE.match(line, b)) or bool(_RIGHT_VERB.match(line, b))
    if _LEFT_LABEL.search(left) or _RIGHT_VERB.match(line, b):
        return True
    return left.endswith(", ") and bool(_LINE_END.match(line, b)) and bool(_LEFT_GREETING.search(left))


def _names(line: str, lexicon: Lexicon):
    for m in _CAPITAL_PAIR.finditer(line):
        name, (a, b) = m.group(1), m.span(1)
        if _INSTITUTION.match(line, b):
            continue
        if lexicon.known_pair(name):
            yield a, b
            continue
        if _NO_NAME.match(name):
            continue
        words = [w for w in name.replace(",", "").split() if len(w) > 2]
        if len({w.isupper() for w in words}) > 1:  # a name is set in capitals as a whole or not at all
            continue
        if name[0] in "dD" and name[1] in "'’" and re.search(r"[a-zà-ÿ] $", line[max(0, a - 2) : a]) and not _takes_name(_LEFT_WORD.search(line[max(0, a - 80) : a]).group(1)):
            yield a + 2, b  # "nom d'Anatole ...": an elided preposition
        elif _in_context(line, a, b):
            yield a, b


def _eastern_names(line: str, lexicon: Lexicon):
    if _HANGUL.search(line):
        for p in (_KO_LABEL, _KO_HONORED):
            for m in p.finditer(line):
                group = m.lastindex
                name = m.group(group)
                if len(name.replace(" ", "")) >= 3 and name not in lexicon.given:
                    yield m.span(group)
    if not _HAN.search(line):
        if lexicon.eastern and _HANGUL.search(line):
            for m in lexicon.eastern.finditer(line):
                yield m.span()
        return
    for p in (_JA_LABEL, _JA_HONORED) if _JA_SIGNS.search(line) else ():
        for m in p.finditer(line):
            if len(m.group(1).replace(" ", "")) >= 4:
                yield m.span(1)
    for p in (_ZH_LABEL, _ZH_HONORED) if _ZH_SIGNS.search(line) else ():
        for m in p.finditer(line):
            group = m.lastindex
            name = m.group(group)
            if _ZH_NO_NAME.search(name) or (p is _ZH_HONORED and group == 1 and len(name) == 4 and name[:2] not in lexicon.compound | _ZH_COMPOUND):
                continue
            if len(name) >= 3 or (name[0] in lexicon.family and name not in lexicon.compound and name[1:] in lexicon.given):
                yield m.span(group)
    if lexicon.eastern:
        for m in lexicon.eastern.finditer(line):
            yield m.span()


def _addresses(line: str, take) -> None:
    for hint, p in zip(_ADDRESS_HINT, _ADDRESS):
        if hint.search(line):
            for m in p.finditer(line):
                take(m.start(), m.end(), "address")


_DIGIT = re.compile(r"\d")
_HANGUL, _HAN = re.compile("[가-힣]"), re.compile("[一-龥ヶ々]")
_JA_SIGNS = re.compile("[者名前当表任出宛取]|様|さん|氏|殿")
_ZH_SIGNS = re.compile("[员者名件人辑户对]|老师|先生|女士|小姐|教授|博士|收")
_DIGIT5 = re.compile(r"\d[\d \-.)）]*\d")
_WESTERN_HINT = re.compile(r"[A-ZÀ-ÞА-ЯЁ][\w.'’\-]+,? [A-ZÀ-ÞА-ЯЁDd]")


def _in_line(line: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """Mentions of one line; where kinds overlap the earlier rule wins."""
    out: list[tuple[int, int, str]] = []

    def take(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, kind))

    if "@" in line or "＠" in line or "at]" in line or "at)" in line or "AT]" in line or "AT)" in line:
        for m in _EMAIL.finditer(line):
            take(m.start(), m.end(), "email")
    if _DIGIT5.search(line):
        if any(w in line for w in _BORN_HINTS):
            for m in _BIRTH.finditer(line):
                take(*m.span(1), "date")
        for m in _ID.finditer(line):
            if sum(c.isdigit() for c in m.group(1)) >= 5:
                take(*m.span(1), "id_number")
        _addresses(line, take)
        for m in _PHONE.finditer(line):
            a, b = m.span(1) if m.group(1) else m.span(2) if m.group(2) else m.span()
            if 8 <= sum(c.isdigit() for c in line[a:b]) <= 15:
                take(a, b, "phone")
    elif _DIGIT.search(line):
        _addresses(line, take)
    if _WESTERN_HINT.search(line):
        for a, b in _names(line, lexicon):
            take(a, b, "person")
    if not line.isascii():
        for a, b in _eastern_names(line, lexicon):
            take(a, b, "person")
    return sorted(out)


_BREAK = re.compile(r"[^\n]+")


def mentions(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the mentions of a text, in order, without overlap."""
    if not unicodedata.is_normalized("NFC", text):
        return _decomposed(text, lexicon)
    out = []
    for m in _BREAK.finditer(text):
        base = m.start()
        out.extend((base + a, base + b, k) for a, b, k in _in_line(m.group(), lexicon))
    return out


def _decomposed(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """Mentions found in the composed form, at the offsets of the text as it is."""
    pieces, starts, at = [], [], 0
    for i in range(1, len(text) + 1):
        if i == len(text) or not (unicodedata.combining(text[i]) or "ᅠ" <= text[i] <= "ᇿ"):
            piece = unicodedata.normalize("NFC", text[at:i])
            pieces.append(piece)
            starts.extend([at] * len(piece))
            at = i
    starts.append(len(text))
    composed = "".join(pieces)
    out = []
    for m in _BREAK.finditer(composed):
        base = m.start()
        out.extend((starts[base + a], starts[base + b], k) for a, b, k in _in_line(m.group(), lexicon))
    return out


# ---- pseudonyms


def permute_digits(digits: str, key: bytes, *, undo: bool = False, rounds: int = 10) -> str:
    """Keyed permutation of all digit strings of one length: an alternating Feistel network in base ten."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + (-1 if undo else 1) * (hashlib.blake2b(b"1", key=key, digest_size=8).digest()[0] % 10)) % 10) if n else ""
    u = n // 2
    a, b = digits[:u], digits[u:]

    def f(value: str, i: int, width: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{n}:{i}:{value}".encode(), key=key, digest_size=16).digest(), "big") % 10**width

    for i in reversed(range(rounds)) if undo else range(rounds):
        if i % 2 == 0:  # the left part is masked by the right one
            a = str((int(a) + (-1 if undo else 1) * f(b, i, len(a))) % 10 ** len(a)).zfill(len(a))
        else:
            b = str((int(b) + (-1 if undo else 1) * f(a, i, len(b))) % 10 ** len(b)).zfill(len(b))
    return a + b


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1), 73_049  # to the end of 2099


def permute_below(value: int, most: int, key: bytes, *, undo: bool = False) -> int:
    """Keyed permutation of 0 .. most - 1: that of all numbers of as many digits, repeated until the value is in range."""
    width = len(str(most - 1))
    while True:
        value = int(permute_digits(str(value).zfill(width), key, undo=undo))
        if value < most:
            return value


def permute_date(mention: str, key: bytes, *, undo: bool = False) -> str | None:
    """The date of 1900 to 2099 that the keyed permutation gives, written as the mention is; None if it is no such date.

    Of day and month in figures the day comes first, unless only the other order
    makes a date.
    """
    m = _ONE_DATE.fullmatch(mention)
    if not m:
        return None
    place = next(p for p in "12345" if m.group(f"y{p}"))
    names = {part: f"{part}{place}" for part in "dmy"}
    named = _MONTH_NAMES.get(m.group(names["m"]).casefold())
    year, month, day = int(m.group(names["y"])), named[1] + 1 if named else int(m.group(names["m"])), int(m.group(names["d"]))
    if place == "1" and month > 12:
        names["d"], names["m"], month, day = names["m"], names["d"], day, month
    try:
        old = datetime.date(year, month, day)
    except ValueError:
        return None
    if not 0 <= (old - _FIRST_DAY).days < _DAYS:
        return None
    new = _FIRST_DAY + datetime.timedelta(permute_below((old - _FIRST_DAY).days, _DAYS, key, undo=undo))
    written = {names["y"]: f"{new.year:04}", names["m"]: named[0][new.month - 1] if named else str(new.month), names["d"]: str(new.day)}
    out = mention
    padded = all(m.end(names[part]) - m.start(names[part]) > 1 for part in "dm") and not (named and mention[m.start(names["d"])] != "0")
    for name in sorted(written, key=m.start, reverse=True):
        out = out[: m.start(name)] + (written[name].zfill(2) if padded else written[name]) + out[m.end(name) :]
    return out


def _weighted(digits: str, weights) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights))


def _luhn(p: str) -> str:
    return str(-sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(p))) % 10)


def _steuer(p: str) -> str:
    product = 10
    for d in p:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return str((11 - product) % 10)


def _snils(p: str) -> str:
    return f"{_weighted(p, range(9, 0, -1)) % 101 % 100:02}"


def _inn12(p: str) -> str:
    one = str(_weighted(p, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10)
    return one + str(_weighted(p + one, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10)


def _my_number(p: str) -> str:
    rest = _weighted(reversed(p), (2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6)) % 11
    return str(0 if rest <= 1 else 11 - rest)


# Identity numbers with a check (Luhn numbers, Korean, Chinese, Spanish, French, German, Russian, Japanese):
# form, characters of the check, its rule, and where a date of birth stands in the rest (start, length).
_CHECKED = (
    (r"\d{13}", 1, lambda p: str((11 - _weighted(p, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11) % 10), (0, 6)),
    (r"\d{17}[\dX]", 1, lambda p: "10X98765432"[_weighted(p, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)) % 11], (6, 8)),
    (r"\d{8}[A-Z]", 1, lambda p: "TRWAGMYFPDXBNJZSQVHLCKE"[int(p) % 23], None),
    (r"[XYZ]\d{7}[A-Z]", 1, lambda p: "TRWAGMYFPDXBNJZSQVHLCKE"[int(str("XYZ".index(p[0])) + p[1:]) % 23], None),
    (r"\d{15}", 2, lambda p: f"{97 - int(p) % 97:02}", None),
    (r"\d{11}", 1, _steuer, None),
    (r"\d{11}", 2, _snils, None),
    (r"\d{10}", 1, lambda p: str(_weighted(p, (2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10), None),
    (r"\d{12}", 2, _inn12, None),
    (r"\d{12}", 1, _my_number, None),
    (r"\d{13,19}", 1, _luhn, None),
)


def _permute_some(text: str, key: bytes) -> str:
    new = iter(permute_digits("".join(c for c in text if c.isdigit()), key))
    return "".join(next(new) if c.isdigit() else c for c in text)


def permute_identity(compact: str, key: bytes) -> str:
    """Another number of the same format: with a holding check if this one's holds, and with a date where it has one."""
    for form, n, check, date in _CHECKED:
        if not re.fullmatch(form, compact) or check(compact[:-n]) != compact[-n:]:
            continue
        body = compact[:-n]
        if date:
            a, length = date
            written = body[a : a + length] if length == 8 else "19" + body[a : a + length]
            moved = permute_date(f"{written[:4]}-{written[4:6]}-{written[6:]}", key)
            if not moved:
                continue
            # A date without its century stays a date of any: 1900 and 2000 are told by the digit that is kept.
            moved = moved.replace("-", "")[8 - length :]
            if length == 6 and moved == "000229":
                moved = "000228"
            rest = _permute_some(body[:a] + body[a + length + 1 :], key)
            body = rest[:a] + moved + body[a + length] + rest[a:]
        else:
            body = _permute_some(body, key)
        return body + check(body)
    return _permute_some(compact, key)


def pseudonym(kind: str, mention: str, key: bytes) -> str:
    """The typed placeholder of a mention: a number or date permuted in its own format, or a keyed tag."""
    label = kind.upper()
    if kind == "date":
        moved = permute_date(mention, key)
        if moved:
            return f"[{label} {moved}]"
    if kind in ("phone", "id_number"):
        plain = unicodedata.normalize("NFKC", mention) if len(unicodedata.normalize("NFKC", mention)) == len(mention) else mention
        compact = re.sub(r"[\W_]", "", plain)
        new = iter(permute_identity(compact, key) if kind == "id_number" else _permute_some(compact, key))
        return f"[{label} {''.join(next(new) if re.match(r'[^\W_]', c) else c for c in plain)}]"
    plain = unicodedata.normalize("NFKC", mention).casefold()
    if kind == "email":
        plain = re.sub(r"\s*[\[(]at[\])]\s*|\s*@\s*", "@", plain)
        plain = re.sub(r"\s*[\[(]dot[\])]\s*", ".", plain)
    else:
        plain = " ".join(sorted(re.findall(r"\w+", plain))) if kind == "person" else " ".join(plain.split())
    return f"[{label} {hashlib.blake2b(plain.encode(), key=key, digest_size=TAG_BYTES).hexdigest()}]"


def _lexicon(names: DataFrame) -> list[tuple[str, str]]:
    rows = [(r["name_part"], r["kind"]) for r in names.select("name_part", "kind").where("name_part is not null").distinct().take(MOST_NAMES + 1)]
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return rows


_MENTIONS = "doc_id long, kind string, start_pos int, end_pos int, mention string"


def find_mentions(docs: DataFrame, names: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per mention: kind, offsets (end exclusive) and the characters."""
    rows = _lexicon(names)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def scan(batches):
        lexicon = Lexicon(rows)
        for batch in batches:
            out: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.extend((d, k, a, b, t[a:b]) for a, b, k in mentions(t, lexicon))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "kind", "start_pos", "end_pos", "mention"])

    return base.mapInArrow(scan, _MENTIONS)


def redact(docs: DataFrame, names: DataFrame, *, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, redacted, mentions): every document with its mentions replaced by placeholders.

    secret: the key of all pseudonyms, at least LEAST_KEY characters; there is no default.
    """
    if len(secret or "") < LEAST_KEY:
        raise ValueError(f"a secret of at least {LEAST_KEY} characters is needed")
    rows = _lexicon(names)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hidden = hashlib.blake2b(secret.encode(), digest_size=32).digest()

    def scan(batches):
        lexicon = Lexicon(rows)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                found = mentions(t, lexicon) if t else []
                at, parts = 0, []
                for a, b, k in found:
                    parts += [t[at:a], pseudonym(k, t[a:b], hidden)]
                    at = b
                texts.append(None if t is None else "".join([*parts, t[at:]]))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "redacted", "mentions"])

    return base.mapInArrow(scan, "doc_id long, redacted string, mentions int")


def _secret(spark) -> str:
    """The key that ``spark.textloom.secret`` or TEXTLOOM_SECRET gives; else one of this call alone, kept nowhere, so that nobody can undo its pseudonyms."""
    return spark.conf.get("spark.textloom.secret", None) or os.environ.get("TEXTLOOM_SECRET") or secrets.token_hex(32)


def p8_found(spark, sf_dir) -> DataFrame:
    found = find_mentions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"))
    return found.where("kind <> 'date'").select("doc_id", "kind", "start_pos")


def p8_redacted(spark, sf_dir) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"), secret=_secret(spark))
