"""Personal information in free text: found, typed and replaced by placeholders.

Regular expressions propose spans; checksums (Luhn, mod 97, mod 11-10, the letter
and digit checks of national numbers) raise or lower a span's score, and so do the
words next to it. A span counts from a score of ``ACCEPT`` on. Types are settled in
the order of ``TYPES``, and a settled span is masked before the next type looks, so
that a town in an address is no surname and a mail address next to a name speaks for it.
Account and card numbers that mod 97 or Luhn confirm are masked too, so that no part of
them passes for a phone or identity number; they are not one of the types.

No name is listed here. A first pass over all texts, in SQL, collects the words that stand as
given names where little else stands (behind a title or a label, below a greeting, beside a
mail address or a phone number) with several different surnames; such a word speaks for a
name anywhere else.

Each text is read whole by one task; the second pass has no shuffle. Null and empty texts give no
row and stay as they are. A cheap pattern first looks for what every item of a type must have
(a sign, a run of digits, two capitals), and the full patterns read only the surroundings of such
places; patterns have no nested unbounded repeats, so a text of any length takes time in
proportion to it.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Scratch

TYPES = ("email", "id_number", "address", "phone", "name")
ACCEPT = 2.0
#: Characters of the neighbourhood that context words are looked for in.
NEAR = 48
#: A masked span is filled with one private character per type.
MASK = {kind: chr(0xE001 + i) for i, kind in enumerate(TYPES)}

#: A word is taken for a given name if this many documents have it in a telling place, with this many different surnames ...
LEAST_DOCS, LEAST_SURNAMES = 2, 2
#: ... which is at least this share of the documents that have it before a capitalised word at all; whatever the number of documents.
LEAST_SHARE = 0.1


def _fold(word: str) -> str:
    plain = unicodedata.normalize("NFKD", word.lower().replace("ł", "l").replace("ø", "o").replace("ß", "ss"))
    return "".join(c for c in plain if not unicodedata.combining(c))


#: What fills a confirmed account or card number.
OTHER_NUMBER = chr(0xE010)

# Capitalised words that open sentences, letters or addresses and are no part of a name.
NOT_NAMES = frozenset(
    """a ab all also and any apart as at avez avec before beide below best bitte bonjour build but by cas check cheers como could cuando
    danke das dear depuis der die does el en es from good guten hello here hey hi how i if il in interestingly is it just kann la le les
    link los mail merci mi mit monday my no not note nur on once only or order our outside please por pozdrawiam regards ruf saludos
    samples see seit sent setting since so some sunday thank thanks that the this tia to try two unfortunately und unsere use version viele
    we what when with works you your grusse czesc hallo hola road street avenue lane court drive close unit flat suite apt null select from where
    order group table error warn info debug instruments university institute department""".split()
)

_L = r"\p{L}\p{M}"
_W = rf"(?:[OD]['’]|Ma?c)?\p{{Lu}}\p{{Ll}}+(?:['’]\p{{Lu}}\p{{Ll}}+)?"
_SURNAME = rf"{_W}(?:-{_W})?"
_PARTICLE = r"(?:van\s(?:der|den|de)|von\s(?:der|dem)|de\s(?:la|las|los)|van|von|zu|ter|de|du|del|della|da|di|dos|le|la)"
_UP = r"(?:O['’]|MC)?\p{Lu}{2,}(?:-(?:O['’]|MC)?\p{Lu}{2,})?"
_LOW = r"(?:o['’]|mc)?\p{Ll}{2,}(?:-(?:o['’]|mc)?\p{Ll}{2,})?"
_UP_PARTICLE = _PARTICLE.upper().replace(r"\S", r"\s")
_WORDS = re.compile(r"[^\W\d_]+")
_LOW_WORD = regex.compile(r"(?<![\p{L}\p{N}_])\p{Ll}{2,}(?![\p{L}\p{N}_])")
_EDGE_L, _EDGE_R = rf"(?<![{_L}\d_.@'’-]|[^\n]/)", rf"(?![{_L}\d_@(]|-\p{{L}}|['’]\p{{L}})"


def _name_forms(word: str, given: str, particle: str, initial: str) -> str:
    first = rf"(?:{given}|{initial}\.)"
    return rf"(?:{first}(?: {initial}\.)?(?: {particle})? {word}|(?:{particle} )?{word}, {first}(?: {initial}\.)?)"


_NAMES = [
    regex.compile(start + _EDGE_L + _name_forms(word, given, particle, initial) + r"(?<=[\p{L}.])" + _EDGE_R)
    for start, word, given, particle, initial in ((rf"(?=\p{{Lu}}|{_PARTICLE} )", _SURNAME, rf"{_W}(?:-{_W})?", _PARTICLE, r"\p{Lu}"), (r"(?=\p{Lu})", _UP, _UP, _UP_PARTICLE, r"\p{Lu}"), ("", _LOW, _LOW, _PARTICLE, r"\p{Ll}"))
]
_TITLES = r"(?:dr|prof|mr|mrs|ms|frau|herrn?|mme|mlle|monsieur|madame|pani?|sra?|señora?|don|doña)\.?"
# Labels of forms and headers, words of writing and telling, closings, and places where signatures stand.
_NAME_BEFORE = regex.compile(
    rf"(?i)(?:\b(?:contact|kontakt|contacto|attention|attn|z\.? ?hd|name|nom|nombre|nazwisko|author|autor|auteur|owner|user|from|von|to|an|cc|bcc|by|with|ask|asked|tell|told|call|see|meet|met|colleague|boss|supervisor|{_TITLES})\"?[\s:=\"'>]{{1,4}}"
    rf"|(?:regards|grüße|grüßen|thanks|cheers|saludos|atentamente|pozdrawiam|cordialement|lg|mfg|vg)[!,.]*\s+|(?:^|\n)--[ \t]*\n?[ \t]*)$"
)
# Words that a name follows and little else does; in the lower-case form titles and the line below a greeting only.
_SIGNED = r"(?:regards|grüße|grüßen|grusse|saludos|pozdrawiam|cordialement|mfg)[!,.]*"
_TITLE = r"(?:Dr|Prof|Mrs?|Ms|Frau|Herrn?|Mme|Mlle|Monsieur|Madame|Pani?|Sra?|Señora?|Don|Doña)"
_STRONG_BEFORE = regex.compile(
    rf"(?:\b(?i:contact|kontakt|contacto|attention|attn|z\.? ?hd|(?:written|reported|signed|prepared|reviewed|approved|posted|submitted|sent|found) by|credit (?:goes )?to|thanks to)[\s:]{{1,3}}|(?:^|\n)[Bb][Yy] |(?i:\b{_SIGNED}\s+|\bsent from my \p{{L}}+[ \t]*\n[ \t]*)|\b(?:{_TITLE}|{_TITLE.upper()})\.?[ \t])$"
)
_STRONG_LOW = regex.compile(rf"(?:\b(?:dr|prof|mrs?|frau|herrn?|mme|mlle|monsieur|madame|señora?)\.?[ \t]|\b{_SIGNED}[ \t]*\n[ \t]*[-/–—]*[ \t]*)")
# Words of offices and forms, which follow the same words as names do.
_NO_PERSON = frozenset(
    """account admin administration agency agent bank board branch bureau center central centre city club committee company council counter customer data desk details
    director division engineering federal finance form foundation front general group head help hiring hotel hotline human hr info information international it
    kundendienst kundenservice laboratory labs legal line local madam management manager marketing medical national network number office officer online
    operations partner person police press product public quality reception relations research resources sales school security service services sir
    software staff state store studio support system systems team technical technology tools trust united vendor website""".split()
)
_NAME_AFTER = regex.compile(
    rf"(?i)^(?:[\s,;|<(\[:=\"'-]{{1,4}}(?:(?:tel|mail|at|phone|e-mail|\p{{L}}+ )[.:=\s\"']*)?\+?\(?[{''.join(MASK.values())}]|,? (?:said|says|wrote|writes|asked|told|sagte|schrieb|schreibt|a dit|a écrit|écrit|dijo|escribió|napisała?|powiedziała?)\b|\s?\([^)\n]{{0,24}}[{MASK['id_number']}{MASK['phone']}])"
)
# A person's own number or address in brackets, or behind a bar or semicolon.
_NUMBER_AFTER = regex.compile(rf"^ ?[(<|;] ?\+?\(?[{MASK['phone']}{MASK['email']}{MASK['id_number']}]")
_AND_NAME = regex.compile(r" (?:and|und|et|y|i) $")
_METHOD_AFTER = regex.compile(r"(?i)^(?:['’]s)? (?:method|test|equation|correction|coefficient|algorithm|distribution|reaction|index|plot|criterion|theorem|rule|instruments|inc|ltd|gmbh|s\.a|corp|group|& )")
_ALONE_BEFORE = regex.compile(r"(?:^|\n)[-/–—]*[ \t]*$")
_ALONE_AFTER = regex.compile(rf"^(?:[ \t]*(?:\n|$)|[ \t]*[|,][ \t]*[{MASK['email']}{MASK['phone']}])")

_MAIL = regex.compile(
    r"(?i)(?<![\w.%+/-])(?<![a-z]://[^\s/]{0,64})([a-z0-9](?:[a-z0-9._%+-]{0,62}[a-z0-9])?(?:\s?[(\[{]\s?dot\s?[)\]}]\s?[a-z0-9_+-]{1,40}|\sdot\s[a-z0-9_+-]{1,40}){0,3})"
    r"(?:\s?@\s?|\s?[(\[{]\s?(?:at|ät|arroba|@)\s?[)\]}]\s?|\s(?:at|arroba|chez|małpa)\s)"
    r"([a-z0-9-]+(?:(?:\.|\s?[(\[{]\s?(?:dot|punkt|punto|point|kropka)\s?[)\]}]\s?|\s(?:dot|punkt|punto|point|kropka)\s)[a-z0-9-]+)*(?:\.|\s?[(\[{]\s?(?:dot|punkt|punto|point|kropka)\s?[)\]}]\s?|\s(?:dot|punkt|punto|point|kropka)\s)[a-z]{2,24})(?![a-z0-9_-])(?!:[\w/])"
)
_ROLE = frozenset("git hg svn root".split())

_ID_WORDS = {
    "ssn": r"(?:ssn|soc(?:ial|\.)?(?: sec(?:urity|\.)?)?(?: (?:number|no))?)",
    "nino": r"(?:nino|ni (?:number|no)|national insurance(?: (?:number|no))?|insurance (?:number|no))",
    "passport": r"(?:passport|passeport|reisepass|pasaporte|paszport)(?:[- ]?(?:number|nummer|no|nr))?",
    "card": r"(?:(?:id|identity) card|personalausweis|ausweis|dni|nie|carte d'identité|dowód(?: osobisty)?|national id|identity|id)(?:[- ]?(?:number|nummer|no|nr))?",
    "tax": r"(?:steuer-?id|steuernummer|tax id|tin|nif|nip)(?:[- ]?(?:number|nummer|no|nr))?",
    "pesel": r"(?:pesel|national (?:id|number)|personal (?:id|number)|numer pesel)(?:[- ]?(?:number|no|nr))?",
    "nir": r"(?:sécurité sociale|numéro de sécu|n° de sécu|nir|insee|sécu)",
}
_ID_SHAPES = {
    "ssn": r"\d{3}[- ]?\d{2}[- ]?\d{4}",
    "nino": r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    "passport": r"[A-Z]{0,2} ?\d{7,9}",
    "card": r"[XYZ]?\d{7,8}-?[A-Z]|[A-Z]{3} ?\d{6}|[A-Z]\d{2}[A-Z0-9]{6}\d?|\d{9,12}",
    "tax": r"\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{3}-\d{3}-\d{2}-\d{2}|\d{8}[A-Z]",
    "pesel": r"\d{11}",
    "nir": r"[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?",
}
_IDS = {kind: regex.compile(rf"(?<![\w.+-])(?:{shape})(?![\w]|[.-]\d)") for kind, shape in _ID_SHAPES.items()}
_ID_NEAR = {kind: regex.compile(rf"(?i)\b{words}(?: (?:is|ist|es|est|to|was))?[\s.:=#\"'()°]{{1,5}}$") for kind, words in _ID_WORDS.items()}
#: Score of the bare shape of each kind of number.
_ID_BASE = {"ssn": 0.6, "nino": 1.2, "passport": 0.2, "card": 0.4, "tax": 0.2, "pesel": 0.2, "nir": 0.6}

_PHONE = regex.compile(r"(?<![\w.:/+#-]|\d,)(?:\+|00)?\(?\d(?:[\d()]|[ ./-](?=[\d(])){7,21}(?![\w]|[.-]\d)")
_PHONE_FORMS = regex.compile(
    r"(?:\+|00[1-9])[\d ()./-]+|\(0\)[\d ./-]+|\(\d{3}\) ?\d{3}[-. ]\d{4}|(\d{3})([-. ])\d{3}\2\d{4}|0\d(?:([-. ]?)\d\d)(?:\3\d\d){3}|0\d{2,4} \d{3,4} \d{3,4}|\(?0\d{2,5}\)?[ /-]+\d{3,8}(?:[- ]\d{1,6}){0,2}|\d{3}([ -])\d{3}\4\d{3}"
)
_PHONE_NEAR = regex.compile(r"(?i)(?:\b(?:tel|telefon|téléphone|telephone|teléfono|phone|mobile|mobil|cell|office|fax|whatsapp|signal|call|ring|numéro|numer|nummer|number|llámame|zadzwoń|anrufen|appelez|desk|hotline|handy)\b[^\d\n]{0,16})$")
_NOT_PHONE = regex.compile(r"(?i)\b(?:order|cas|isbn|issn|lot|build|version|checksum|doi|invoice|batch|rows?|pages?|timestamp|size|sha|md5|iban|card|account|konto|ticket|serial|part no|sku)\b(?:[^\d\n.]|\.(?! \p{Lu})){0,12}$")

_TOWN = r"\p{Lu}\p{Ll}+(?:-\p{Ll}{2,4}(?=-))?(?:[ -]\p{Lu}\p{Ll}+)?"
_ZIP = r"(?:\d{2}-\d{3}|\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})(?![\d-])"
_SEP = r"(?:,[ \t]*\n?[ \t]*|[ \t]*\n[ \t]*|[ \t]+)"
_UNIT = r"(?:(?:,[ \t]*\n?|[ \t]*\n|[ \t])[ \t]*(?:(?:Unit|Flat|Apt|Apartment|Suite|Ste|Floor|Room)\.? ?#?\d{1,4}[A-Za-z]?|#\d{1,4}[A-Z]?))?"
_AFTER_STREET = rf"(?:{_SEP}{_TOWN},?\s{_ZIP}|{_SEP}{_ZIP} {_TOWN}|,[ \t]*{_TOWN}(?=[.,;)\s\"]|$)|[ \t]*\n{_TOWN}(?=[.,;)]|\s*\n|\s*$)|,? {_ZIP})?"
_ZIP_TOWN = rf"(?:{_SEP}{_ZIP} {_TOWN}|,[ \t]*{_TOWN}(?=[.,;)\s\"]|$))?"
_CAPS = rf"\p{{Lu}}[{_L}'’-]+"
_ADDRESSES = [
    regex.compile(rf"(?<![\w.,-])\d{{1,4}}[A-Za-z]? (?:{_CAPS} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln|Court|Ct|Close|Boulevard|Blvd|Way|Place|Square|Sq|Terrace|Crescent|Parkway|Row|Gardens)\b\.?{_UNIT}{_AFTER_STREET}"),
    regex.compile(rf"(?i:\bP\.? ?O\.? ?Box|\bPostfach|\bApartado(?: de correos)?|\bBoîte postale|\bB\.?P\.?|\bSkrytka pocztowa|\bskr\. poczt\.) \d{{1,6}}\b(?:{_AFTER_STREET})"),
    regex.compile(rf"(?<![\w-])(?:{_CAPS} )?(?:\p{{Lu}}?[{_L}]+)?(?:[sS]tra(?:ß|ss)e|[sS]tr\.|[wW]eg|[gG]asse|[aA]llee|[pP]latz|[rR]ing|[dD]amm|[uU]fer) \d{{1,4}}(?: ?[a-z]\b)?{_ZIP_TOWN}"),
    regex.compile(rf"(?<![\w.,-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:[rR]ue|[aA]venue|[bB]oulevard|[bB]d|[aA]llée|[pP]lace|[iI]mpasse|[cC]hemin|[qQ]uai|[cC]ours|[sS]quare)(?: (?:de la|de l['’]|des|du|de|d['’]|la|le|les|aux?))?(?: ?{_CAPS}){{1,3}}(?:,? ?(?:bât|apt|appt)\.? \w{{1,3}})?{_ZIP_TOWN}"),
    regex.compile(rf"\b(?:Calle|C/|C\.|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Paseo|Camino|Ronda|Travesía|Rúa)(?: (?:de las|de los|de la|del|de))?(?: {_CAPS}){{1,3}},? (?:n[ºo.] ?)?\d{{1,4}}(?:, ?(?:bajo|ático|\d{{1,2}}º ?\p{{Lu}}?))?{_ZIP_TOWN}"),
    regex.compile(rf"\b(?:ul|al|os|pl)\. (?:{_CAPS} ){{1,3}}\d{{1,4}}[a-zA-Z]?(?: ?/ ?\d{{1,4}}| ?m\. ?\d{{1,4}})?{_ZIP_TOWN}"),
]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of international account numbers: four characters moved to the end, letters as 10..35."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _eleven_ten(digits: str) -> bool:
    rest = 10
    for d in digits[:-1]:
        rest = ((int(d) + rest) % 10 or 10) * 2 % 11
    return (11 - rest) % 10 == int(digits[-1])


def confirms(kind: str, text: str) -> bool:
    """Whether the number's own checksum, or its reserved ranges where it has none, hold."""
    bare = regex.sub(r"[\s-]", "", text)
    digits = regex.sub(r"\D", "", text)
    if kind == "card" and regex.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", bare):
        number = int(bare[:-1].translate(str.maketrans("XYZ", "012")))
        return "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23] == bare[-1]
    if kind == "pesel":
        return sum(int(d) * w for d, w in zip(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1))) % 10 == 0
    if kind == "tax" and len(digits) == 11:
        return digits[0] != "0" and _eleven_ten(digits)
    if kind == "nir" and len(digits) == 15:
        return 97 - int(digits[:13]) % 97 == int(digits[13:])
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "nino":
        return bare[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ") and not set(bare[:2]) & set("DFIQUV") and bare[1] != "O"
    return False


_ANY_DIGIT = regex.compile(r"\d")
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|punto|point|kropka)|\s(?:dot|punkt|punto|point|kropka)\s)"
#: What every mail address, identity number, phone number and address must have.
_MAIL_SIGN = regex.compile(rf"(?i)(?:@\s?|[(\[{{]\s?(?:at|ät|arroba|@)\s?[)\]}}]\s?|\s(?:at|arroba|chez|małpa)\s)[a-z0-9-]{{1,63}}{_DOT}")
_ID_SIGN = regex.compile(r"\d(?:[ -]?\d){5}|[A-Z]\d{2}[A-Z0-9]{6}")
_PHONE_SIGN = regex.compile(r"\d(?:[ ()./-]{0,2}\d){8}")
_NUMBER_FIRST = regex.compile(r"(?<![\w.,-])\d{1,4}[A-Za-z]?(?: ?(?:bis|ter))?,? (?:\p{Lu}|rue|avenue|boulevard|bd|allée|place|impasse|chemin|quai|cours|square)")
_STREET_LAST = regex.compile(r" (?=\d)(?<=(?:[sS]tra(?:ß|ss)e|[sS]tr\.|[wW]eg|[gG]asse|[aA]llee|[pP]latz|[rR]ing|[dD]amm|[uU]fer) )")
_BOX = regex.compile(r" (?=\d)(?<=(?i:box|postfach|apartado|correos|postale|b\.?p\.?|pocztowa|poczt\.) )")
_ACCOUNT = regex.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])")
_CARD = regex.compile(r"(?<![\w+.-])\d{4}(?:([ -]?)\d{4})(?:\1\d{4}){1,2}(?:\1\d{1,4})?(?![\w]|[.-]\d)")


def _places(sign: regex.Pattern, text: str, before: int, after: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text around the matches of ``sign``; those that touch are one."""
    start = end = -1
    for m in sign.finditer(text):
        lo, hi = max(0, m.start() - before), m.end() + after
        if lo > end:
            if end >= 0:
                yield start, end
            start = lo
        end = hi
    if end >= 0:
        yield start, end


def _emails(text: str, known: frozenset) -> Iterator[tuple[int, int, float]]:
    for lo, hi in _places(_MAIL_SIGN, text, 200, 260):
        for m in _MAIL.finditer(text, lo, hi):
            spoken = "@" not in m.group(0)
            dotted = regex.search(r"(?i)[(\[{\s](?:dot|punkt|punto|point|kropka)\b", m.group(2)) is not None
            bracketed = regex.search(r"[(\[{]", m.group(0)) is not None
            score = 2.0 if not spoken or dotted or bracketed else 1.0  # "at host.tld" in prose
            if spoken and not dotted and not bracketed and regex.search(r"[._\d]", m.group(1)):
                score += 1.0
            if m.group(1).lower() in _ROLE:
                score -= 2.0
            yield m.start(), m.end(), score


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """International account numbers that mod 97 confirms."""
    for m in _ACCOUNT.finditer(text):
        bare = m.group(0).replace(" ", "")
        if 15 <= len(bare) <= 34 and mod97(bare):
            yield m.start(), m.end()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    """Payment card numbers that Luhn confirms."""
    for m in _CARD.finditer(text):
        digits = regex.sub(r"\D", "", m.group(0))
        if 13 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits):
            yield m.start(), m.end()


def _id_numbers(text: str, known: frozenset) -> Iterator[tuple[int, int, float]]:
    for lo, hi in _places(_ID_SIGN, text, 12, 24):
        for kind, pattern in _IDS.items():
            for m in pattern.finditer(text, lo, hi):
                before = text[max(0, m.start() - NEAR) : m.start()]
                score = _ID_BASE[kind] + confirms(kind, m.group(0)) * (0.8 if kind in ("ssn", "nino") else 1.0)
                if _ID_NEAR[kind].search(before):
                    score += 2.0
                elif kind == "nino" and regex.search(r"\s", m.group(0)) is None:
                    score -= 0.6
                elif _NOT_PHONE.search(before):
                    score -= 2.0
                yield m.start(), m.end(), score


# Words and places that an address follows; a street and number without a town, code or unit needs one of them.
_ADDRESS_BEFORE = regex.compile(
    r"(?i)(?:(?:^|\n)[ \t>*-]*|[,;:(\[\"'|][ \t]*\n?[ \t]*|\b(?:at|in|on|to|from|near|of|is|am|an der|in der|zur|zum|ist|lautet|au|à|en|est|es|vivo en|na|przy|pod|address|adresse|dirección|adres|anschrift|live|lives|living|moved|visit|ship|send|deliver(?:y|ed)?|pick(?:ed)? up|office|home|house|lab)\s{1,2}(?:is |ist |est |es |the |der |die )?)$"
)


_COUNTED = regex.compile(r"(?i)\b(?:version|build|page|chapter|section|table|figure|rows?|steps?|lines?|no\.|number)\s{1,2}$")


def _addresses(text: str, known: frozenset) -> Iterator[tuple[int, int, float]]:
    def proposals() -> Iterator[regex.Match]:
        for m in _NUMBER_FIRST.finditer(text):
            for pattern in (_ADDRESSES[0], _ADDRESSES[3]):
                if whole := pattern.match(text, m.start()):
                    yield whole
        for lo, hi in _places(_BOX, text, 24, 120):
            yield from _ADDRESSES[1].finditer(text, lo, hi)
        for lo, hi in _places(_STREET_LAST, text, 90, 120):
            yield from _ADDRESSES[2].finditer(text, lo, hi)
        yield from _ADDRESSES[4].finditer(text)
        yield from _ADDRESSES[5].finditer(text)

    for m in proposals():
        numbers = len(regex.findall(r"\d+", m.group(0)))
        score = 1.5 + 0.8 * (numbers > 1 or "," in m.group(0) or "\n" in m.group(0))
        score += 0.6 * bool(_ADDRESS_BEFORE.search(text[max(0, m.start() - NEAR) : m.start()]))
        score += 0.6 * (regex.match(r"\p{L}", m.group(0)) is not None)  # a word for street or box leads, so the number is no count
        if _COUNTED.search(text[max(0, m.start() - NEAR) : m.start()]):
            score -= 1.0
        yield m.start(), m.end(), score


def _phones(text: str, known: frozenset) -> Iterator[tuple[int, int, float]]:
    for lo, hi in _places(_PHONE_SIGN, text, 8, 30):
        for m in _PHONE.finditer(text, lo, hi):
            written = m.group(0).rstrip(" ./-(")
            if written.count(")") > written.count("("):  # "Name (020 7946 0332)": the bracket is not its own
                written = written.rstrip(")")
            elif written[0] == "(" and written[-1] == ")":
                written = written[1:-1]
            digits = regex.sub(r"\D", "", written)
            before = text[max(0, m.start() - NEAR) : m.start()]
            if not 8 < len(digits) < 16 or written.count("(") != written.count(")"):
                continue
            score = (1.8 if written[0] in "+(" or written.startswith("00") else 1.2) if _PHONE_FORMS.fullmatch(written) else -0.5
            score += 0.8 if regex.search(r"[ ().-]", written) or written[0] == "+" else 0.3
            score += 1.6 * bool(_PHONE_NEAR.search(before))
            score -= 3.0 * bool(_NOT_PHONE.search(before))
            if len(digits) > 12 and luhn(digits) and written[0] != "+" and not written.startswith("00"):
                score -= 1.5  # a payment card
            if regex.match(r"(?:19|20)\d\d[-./]\d\d[-./]\d\d", written):
                score -= 3.0  # a date
            start = text.index(written, m.start())
            yield start, start + len(written), score


def _next_known(pattern: regex.Pattern, text: str, at: int, known: frozenset) -> regex.Match | None:
    """The next lower-case name: looked for only where a known given name is."""
    for hit in _LOW_WORD.finditer(text, at):
        if _fold(hit.group()) in known and (m := pattern.search(text, max(at, hit.start() - NEAR), min(len(text), hit.end() + NEAR))):
            return m
    return None


def _unlisted_low(pattern: regex.Pattern, text: str) -> Iterator[tuple[int, int, float]]:
    """Lower-case names behind a title, or alone on the line below a greeting, whatever the given name."""
    for hit in _STRONG_LOW.finditer(text):
        m = pattern.match(text, hit.end(), min(len(text), hit.end() + NEAR))
        if m is None or "\n" in hit.group(0) and not _ALONE_AFTER.search(text[m.end() : m.end() + NEAR]):
            continue
        words = [_fold(w.strip(".,")) for w in m.group(0).split()]
        if not any(w in NOT_NAMES or w in _NO_PERSON for w in words if len(w) > 1) and not _METHOD_AFTER.search(text[m.end() : m.end() + NEAR]):
            yield m.start(), m.end(), ACCEPT


_TWO_CAPITALS = regex.compile(r"\p{Lu}\p{Ll}+,? (?:\p{Lu}|\p{Ll}{1,3} )|\p{Lu}\. ?\p{L}|, \p{Lu}\.")
_TWO_UPPER = regex.compile(r"\p{Lu}{2,}[,.]? \p{Lu}|\p{Lu}\. \p{Lu}{2}")


def _names(text: str, known: frozenset) -> Iterator[tuple[int, int, float]]:
    for form, pattern in enumerate(_NAMES):
        if form < 2:
            if not (_TWO_CAPITALS, _TWO_UPPER)[form].search(text):
                continue
        elif known.isdisjoint(_WORDS.findall(text)):
            continue
        previous_end, at = -99, 0
        while m := pattern.search(text, at) if form < 2 else _next_known(pattern, text, at, known):
            words = m.group(0).replace(",", " ").split()
            # A rejected proposal may hide a name that starts at its second word.
            at = m.start() + len(regex.match(r"\S+\s*", m.group(0)).group(0))
            if any(_fold(w.strip(".")) in NOT_NAMES for w in words if len(w.strip(".")) > 1 and w.lower() not in ("la",)):
                continue
            before, after = text[max(0, m.start() - NEAR) : m.start()], text[m.end() : m.end() + NEAR]
            reverse = "," in m.group(0)
            given = m.group(0).rpartition(", ")[2].split()[0] if reverse else words[0]
            is_known = _fold(given).split("-")[0] in known
            if form == 2 and not is_known:
                continue
            score = 2.0 * is_known + 1.0 * given.endswith(".")
            near = bool(_NAME_BEFORE.search(before)) or (_AND_NAME.search(before) is not None and m.start() - previous_end < 8)
            score += 1.5 * near + 1.0 * bool(_NAME_AFTER.search(after))
            no_person = any(_fold(w) in _NO_PERSON for w in words)
            if form < 2 and not is_known and not reverse and _STRONG_BEFORE.search(before) and not no_person:
                score += ACCEPT - 1.5 * near
            alone = bool(_ALONE_BEFORE.search(before)) and bool(_ALONE_AFTER.search(after))
            score += 1.0 * alone
            if alone and form < 2 and not no_person and len(text) - m.end() < 2 * NEAR:
                score += 1.0  # a line of its own at the end of the text
            if form == 2 and not (near or alone or _NAME_AFTER.search(after)):
                score -= 1.0
            if form < 2 and not is_known and not reverse and _NUMBER_AFTER.search(after) and not no_person:
                score += 1.0
            if reverse and not is_known:
                score -= 0.5 if near else 1.0
            if _METHOD_AFTER.search(after) or before.endswith(("@", "& ")):
                score -= 3.0
            if score >= ACCEPT:
                previous_end = at = m.end()
            yield m.start(), m.end(), score
    yield from _unlisted_low(_NAMES[2], text)


_FINDERS = {"email": _emails, "id_number": _id_numbers, "address": _addresses, "phone": _phones, "name": _names}
_NOBODY: frozenset = frozenset()


def _masked(text: str, spans: list[tuple[int, int]], fill: str) -> str:
    parts, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], fill * (end - start)]
            at = end
    return "".join([*parts, text[at:]])


def find_spans(text: str, known: frozenset = _NOBODY) -> list[tuple[int, int, str]]:
    """(start, end, type) of all items, in order and without overlap; from the first to the last letter or digit.

    ``known`` are folded words that are given names elsewhere; without them names need a title, a label or a neighbour.
    """
    found: list[tuple[int, int, str]] = []
    masked = text
    digits = _ANY_DIGIT.search(text) is not None
    for kind in TYPES:
        if not digits and kind in ("id_number", "address", "phone"):
            continue
        if kind == "id_number":
            masked = _masked(masked, list(_accounts(masked)), OTHER_NUMBER)
        elif kind == "address":
            masked = _masked(masked, list(_cards(masked)), OTHER_NUMBER)
        starts: list[int] = []
        ends: list[int] = []
        for start, end, _ in sorted((s for s in _FINDERS[kind](masked, known) if s[2] >= ACCEPT), key=lambda s: (-s[2], s[0] - s[1], s[0])):
            while end > start and not text[end - 1].isalnum():
                end -= 1
            while start < end and not text[start].isalnum():
                start += 1
            at = bisect.bisect_left(starts, start)  # settled spans are sorted and apart: only the two beside it can overlap
            if start < end and (at == 0 or ends[at - 1] <= start) and (at == len(starts) or end <= starts[at]):
                starts.insert(at, start)
                ends.insert(at, end)
        if starts:
            spans = list(zip(starts, ends))
            masked = _masked(masked, spans, MASK[kind])
            found += [(s, e, kind) for s, e in spans]
    return sorted(found)


def redact(text: str, known: frozenset = _NOBODY) -> str:
    """The text with each item replaced by a placeholder such as ``[EMAIL]``."""
    parts, at = [], 0
    for start, end, kind in find_spans(text, known):
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


# Where little but a name stands, in Java's syntax: behind titles, labels and closings, beside mail addresses and phone numbers.
_J_WORD = r"\p{Lu}\p{Ll}+(?:['’-]\p{Lu}\p{Ll}+)?"
_J_NAME = rf"({_J_WORD} (?:(?:van|von|de|del|della|di|da|la|le|der|den|ter|zu) ){{0,2}}{_J_WORD})(?![\p{{L}}\d_])"
_J_BEFORE = (
    r"(?:\b(?:Dr|Prof|Mrs?|Ms|Herrn?|Frau|Mme|Mlle|Sra?|Señora?|Doña?|Pani?)\.? |\b(?i:name|contact|kontakt|contacto|author|autor|auteur|attn|(?:written|reported|signed|posted|sent) by)(?:: ?| )"
    r"|(?i:regards|grüße|grüßen|saludos|atentamente|pozdrawiam|cordialement|cheers|thanks|mfg)[,.!]?[ \t]*\n[ \t]*(?:[-–—/]+[ \t]*)?)" + _J_NAME
)
_J_AFTER = _J_NAME + r"(?= ?[,<(|;] ?(?:[\w.+-]+@|\+?\(?\d[\d ()./-]{7}))"
_J_FIRST = r"(\p{Lu}\p{Ll}+)(?:-\p{Lu}\p{Ll}+)? (?=\p{Lu}\p{Ll})"


def given_names(docs: DataFrame, text: str = "text") -> frozenset:
    """Words, as written in small letters and without accents, that the texts themselves show to be given names; see the constants for what a word must show.

    One pass in SQL over all texts, counted by document before any shuffle. A word must show the same in few texts and in many.
    The driver gets the learned words and sends them to the tasks: a vocabulary of given names, which grows with the names there are, not with the texts.
    """
    body = docs.where(F.col(text) != "").select(F.col(text).alias("t"))
    told = F.array_distinct(F.concat(F.regexp_extract_all("t", F.lit(_J_BEFORE), 1), F.regexp_extract_all("t", F.lit(_J_AFTER), 1)))
    first = lambda name: F.split_part(F.split_part(name, F.lit(" "), F.lit(1)), F.lit("-"), F.lit(1))
    names = F.transform(told, lambda n: F.struct(first(n).alias("w"), F.split_part(n, F.lit(" "), F.lit(-1)).alias("surname"), F.lit(True).alias("told")))
    seen = F.transform(F.array_distinct(F.regexp_extract_all("t", F.lit(_J_FIRST), 1)), lambda w: F.struct(w.alias("w"), F.lit(None).cast("string").alias("surname"), F.lit(False).alias("told")))
    rows = body.select(F.inline(F.concat(names, seen)))
    counts = Scratch(docs.sparkSession, "names").save(rows.groupBy("w", "surname", "told").agg(F.count("*").alias("n")), "counts")  # the texts are read once
    words = counts.groupBy("w").agg(F.sum(F.when(F.col("told"), F.col("n"))).alias("told"), F.count("surname").alias("surnames"), F.sum(F.when(~F.col("told"), F.col("n"))).alias("seen"))
    kept = words.where((F.col("told") >= LEAST_DOCS) & (F.col("surnames") >= LEAST_SURNAMES) & (F.col("told") >= LEAST_SHARE * F.coalesce("seen", F.lit(0))))
    found = [r.w.lower() for r in kept.select("w").collect()]
    return frozenset(form for w in found for form in (w, _fold(w)) if _fold(w) not in NOT_NAMES and _fold(w) not in _NO_PERSON)


def personal_items(docs: DataFrame, key: str = "doc_id", text: str = "text", known: frozenset | None = None) -> DataFrame:
    """(key, pii_type, pii_text): one row per different item of each document, exactly as written.

    ``known`` given names default to those that ``given_names`` learns from ``docs``.
    """
    source = docs.where((F.col(text) != "") & F.col(key).isNotNull()).select(key, F.col(text).alias("__text"))
    names = given_names(docs, text) if known is None else known

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, items = [], [], []
            for i, t in enumerate(batch.column("__text").to_pylist()):
                for kind, item in dict.fromkeys((k, t[s:e]) for s, e, k in find_spans(t, names)):
                    at.append(i)
                    kinds.append(kind)
                    items.append(item)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(items, pa.string())], [key, "pii_type", "pii_text"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(scan, f"`{key}` {kind}, pii_type string, pii_text string").distinct()


def redacted_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", known: frozenset | None = None) -> DataFrame:
    """(key, text) of every document, with placeholders; null and empty texts stay as they are."""
    source = docs.select(key, text)
    names = given_names(docs, text) if known is None else known

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [redact(t, names) if t else t for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(clean, pa.string())], [key, text])

    return source.mapInArrow(scan, source.schema)
