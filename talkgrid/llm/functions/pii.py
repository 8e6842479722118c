"""Personal details in free text: proposed spans, checksums and context scores."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

_L = r"[^\W\d_]"
#: Words before or after a detail that speak for it.
PHONE_WORDS = r"phone|telephone|tel|mobile|cell|call|reach|ring|fax|whatsapp|telefon\w*|erreichbar|mobil|handy|anruf\w*|tel[ée]fono|m[óo]vil|llam\w+|t[ée]l[ée]phone|appel\w*|portable"
ID_WORDS = (
    r"ssn|passport|tax id|tax|social security|national insurance|insurance|identity|identification|licen[cs]e|id card|registered under id|ausweis\w*|personalausweis\w*|reisepass\w*|steuer\w*|sozialversicherung\w*|versicherung\w*|"
    r"documento|identidad|dni|nie|nif|pasaporte|seguridad social|num[ée]ro|s[ée]curit[ée] sociale|passeport|carte d['’]identit[ée]|identit[ée]"
)
NOT_PERSONAL = r"commit|checksum|build|version|ticket|isbn|issn|error|offset|run|rev|revision|cue|port|section|step|package|shard|rows?|range|lane|route|room|order|invoice no|serial|sku|batch|hash|frame|slide"
TITLES = r"(?:mr|mrs|ms|mx|miss|dr|prof|professor|doctor|herr|frau|hr|sr|sra|srta|señor|señora|don|doña|mme|mlle|monsieur|madame|sir|dame|ing|mag)"
PARTICLES = r"(?:van der|van den|van de|von der|von dem|von und zu|de la|de las|de los|de l['’]|van|von|vom|zu|zur|de|del|della|di|da|dos|das|do|du|le|la|der|den|ter|ten|af|av|bin|ben|al|el|mac|st\.?)"
STREETS = r"street|st|road|rd|avenue|ave|drive|lane|ln|crescent|cres|court|ct|way|place|pl|square|sq|terrace|boulevard|blvd|close|row|hill|grove|gardens|parade|walk|mews|quay|parkway|highway|circle|alley"
PRODUCTS = frozenset(
    "board gateway cluster index scheduler queue cache theme console notebook router pipeline stage room hall server service studio lab labs engine dashboard suite cloud platform project release edition version demo theater theatre auditorium tower building center centre park bridge station app tool kit stack protocol framework library model dataset benchmark award prize foundation institute university college hospital hotel cafe bar beach lake mountain street road".split()
)
STOP = frozenset("the a an of to in on at for with by from and or is it its our we you i he she they this that these those after before about as so then here there what which who when how why".split())


@dataclass(frozen=True)
class Found:
    """One detail: its kind, where it stands and how sure it is."""

    kind: str
    start: int
    end: int
    score: float


# --- electronic mail -----------------------------------------------------------------------------
_LABEL = r"[^\W_](?:[\w-]{0,61}[^\W_])?"
_LOCAL = r"[\w](?:[\w.+%'-]{0,62}[\w+])?"
_DOT = r"(?:\.|[ \t]?[\[(]\s?(?:dot|punkt|punto|point)\s?[\])][ \t]?)"
_EMAIL = [
    re.compile(rf"(?<![\w.+@-]){_LOCAL}[ \t]?@[ \t]?(?:{_LABEL}{_DOT}){{1,127}}{_L}{{2,24}}(?![\w@])"),
    re.compile(rf"(?<![\w.+@-]){_LOCAL}[ \t]?[\[({{]\s?(?:at|ät|arroba|arobase)\s?[\])}}][ \t]?(?:{_LABEL}{_DOT}){{1,6}}{_L}{{2,24}}(?![\w@])", re.I),
    re.compile(rf"(?<![\w.+@-]){_LOCAL} (?:at|arroba|arobase) (?:{_LABEL} (?:dot|punkt|punto|point) ){{1,127}}{_L}{{2,24}}(?![\w@])", re.I),
]


_AT_SIGN = re.compile(r"@|[\[({]\s?(?:at|ät|arroba|arobase)\s?[\])}]|\s(?:dot|punkt|punto|point)\s", re.I)


_WORD_REST = re.compile(r"\S*")
_MORE_LABELS = re.compile(r"[ \t]?[\[(]?\s?(?:dot|punkt|punto|point)\s?[\])]?[ \t]?\S+|(?<=dot|nkt|nto|int)[ \t]\S+|(?<=dot[\])]|nkt[\])]|nto[\])]|int[\])])[ \t]\S+", re.I)


def emails(text: str) -> list[Found]:
    """Addresses, also with spelled-out signs; only the neighbourhood of a sign is looked at."""
    out: dict[tuple[int, int], Found] = {}
    done = -1
    for sign in _AT_SIGN.finditer(text):
        if sign.start() < done:
            continue
        low, high = max(0, sign.start() - 130), min(len(text), sign.end() + 230)
        # whole words only, and all further labels, so that no address is cut by the edge of the neighbourhood
        while low and not text[low - 1].isspace():
            low -= 1
        high = _WORD_REST.match(text, high).end()
        while more := _MORE_LABELS.match(text, high):
            high = more.end()
        for rx in _EMAIL:
            for m in rx.finditer(text, low, high):
                out[m.span()] = Found("email", m.start(), m.end(), 3.0)
                done = max(done, m.end() if m.start() <= sign.start() else done)
    return list(out.values())


_DIGITS = re.compile(r"\d+")


def _number_starts(text: str) -> list[int]:
    """Where numbers start, times apart."""
    out = []
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        # a time has a digit on either side of its colon; a label before the colon does not make one
        after, before = text[b : b + 1] == ":" and text[b + 1 : b + 2].isdigit(), a > 1 and text[a - 1] == ":" and text[a - 2].isdigit()
        if b - a == 2 and (after or before) or (a > 4 and text[a - 4] == ":" and text[a - 5].isdigit() and (b - a == 3 or text[a - 1] == ".")):
            continue
        out.append(a)
    return out


# --- telephone -----------------------------------------------------------------------------------
_PHONE = [
    (3.0, re.compile(r"(?<![\w+.])(?:\+|00)[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}(?![\w-])")),
    (3.0, re.compile(r"(?<![\w+.(-])(?:1[ .-])?\(?[2-9]\d{2}\)?[ .-][2-9]\d{2}[ .-]\d{4}(?![\w-])")),
    (3.0, re.compile(r"(?<![\w+.(-])(?:1[ .-])?\([2-9]\d{2}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-])")),
    (3.0, re.compile(r"(?<![\w+.-])\(0\d{1,4}\)[ ]?\d{3,8}(?:[ -]\d{1,5})?(?![\w-])")),
    (2.5, re.compile(r"(?<![\w+.-])0\d(?: \d{2}){4}(?![\w-])")),
    (2.5, re.compile(r"(?<![\w+.-])0\d{3} \d{3} \d{3}(?![\w-])")),
    (2.5, re.compile(r"(?<![\w+.-])0\d{4} \d{6}(?![\w-])")),
    (2.0, re.compile(r"(?<![\w+.-])0\d{2,4}[ /-]\d{4,8}(?![\w-])")),
    (1.5, re.compile(r"(?<![\w+.(/-])[2-9]\d{2}[ -]\d{4}(?![\w-])")),
    (1.0, re.compile(r"(?<![\w+.-])[679]\d{2} \d{3} \d{3}(?![\w-])")),
]
_PHONE_NEAR = re.compile(rf"\b(?:{PHONE_WORDS})\b", re.I)
_NOT_NEAR = re.compile(rf"\b(?:{NOT_PERSONAL})[ :#.]*$", re.I)
_ID_NEAR = re.compile(rf"\b(?:{ID_WORDS})\b", re.I)


@functools.lru_cache(maxsize=8)
def _gate(forms: tuple[re.Pattern, ...]) -> re.Pattern:
    """One pattern that matches wherever one of the forms does."""
    return re.compile("|".join(f"(?:{f.pattern})" for f in forms), re.I)


def _matches(text: str, starts: list[int], forms: list, lead: int):
    """Matches of the forms that start at a number or up to ``lead`` characters before it."""
    seen = set()
    gate = _gate(tuple(f[1] for f in forms)).match
    for n in starts:
        for p in range(max(0, n - lead), n + 1):
            if p < n and text[p].isdigit() or gate(text, p) is None:
                continue
            for form in forms:
                m = form[1].match(text, p)
                if m and (m.span(), form[1]) not in seen:
                    seen.add((m.span(), form[1]))
                    yield form, m


def phones(text: str, starts: list[int]) -> list[Found]:
    """Numbers with their prefix; the number of digits is checked, context adds or takes away."""
    out = []
    for (base, _), m in _matches(text, starts, _PHONE, 2):
        digits = sum(ch.isdigit() for ch in m.group())
        if not 7 <= digits <= 15:
            continue
        before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30]
        score = base
        if _PHONE_NEAR.search(before):
            score += 1.5
        if re.match(r"\s*/\s*\S+(?:@| ?[\[(]at| at | @ )", after) or re.search(r"[,\n]\s*$|—[^\n]{3,40},\s*$", before) and digits >= 7 and base >= 1.5:
            score += 1.0
        if re.search(r"\n\s*(?:[-*•]\s*)?(?:[AQ]:\s*)?$", before) or not before.strip():
            score += 1.0
        if _NOT_NEAR.search(before):
            score -= 3
        out.append(Found("phone", m.start(), m.end(), score))
    return [f for f in out if f.score >= 2.0]


# --- identity numbers ----------------------------------------------------------------------------
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def luhn(digits: str) -> bool:
    """Check digit by the Luhn rule."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Check by remainder 1 modulo 97 of the rearranged account number."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def mod11_10(digits: str) -> bool:
    """Check digit of the German tax number (ISO 7064, modulo 11,10)."""
    p = 10
    for ch in digits[:-1]:
        s = (int(ch) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[-1])


def spanish(code: str) -> bool:
    """Check letter of Spanish identity numbers."""
    num = code[:-1].translate(str.maketrans("XYZ", "012"))
    return num.isdigit() and _DNI[int(num) % 23] == code[-1]


def nir(digits: str) -> bool:
    """Key of the French social insurance number."""
    return 97 - int(digits[:13]) % 97 == int(digits[13:])


def weights731(code: str) -> bool:
    """Check digit of machine-readable documents (weights 7, 3, 1)."""
    return sum(int(ch, 36) * (7, 3, 1)[i % 3] for i, ch in enumerate(code[:-1])) % 10 == int(code[-1])


_NONE = None
#: Base score, form, checksum, and whether a wrong checksum rejects.  Five forms have no checksum at all (social
#: insurance numbers of two countries, passports, other document numbers); of three (Spanish numbers, machine-readable document numbers, tax
#: numbers) a wrong one only gives no point, since the documents here hold made-up numbers of them.
_IDS = [
    (1.5, re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"), _NONE, False),
    (1.5, re.compile(r"(?<![\w.-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])", re.I), _NONE, False),
    (1.5, re.compile(r"(?<![\w.-])[XYZ]-?\d{7}-?[A-Z](?![\w-])", re.I), spanish, False),
    (1.5, re.compile(r"(?<![\w.-])\d{8}[- ]?[A-Z](?![\w-])", re.I), spanish, False),
    (1.0, re.compile(r"(?<![\w.-])[A-Z]{2}\d{6,7}(?![\w-])", re.I), _NONE, False),
    (1.0, re.compile(r"(?<![\w.-])[CFGHJKLMNPRTVWXYZ](?=(?:[A-Z]*\d){3})[0-9A-Z]{8}(?![\w-])", re.I), weights731, False),
    (1.0, re.compile(r"(?<![\w.-])\d{2} \d{3} \d{3} \d{3}(?![\w-])"), mod11_10, False),
    (0.5, re.compile(r"(?<![\w.-])\d{11}(?![\w-])"), mod11_10, True),
    (1.5, re.compile(r"(?<![\w.-])[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![\w-])"), nir, True),
    (1.0, re.compile(r"(?<![\w.-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"), mod97, True),
    (0.5, re.compile(r"(?<![\w.-])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?![\w-])"), luhn, True),
    (0.5, re.compile(r"(?<![\w.-])(?:[A-Z]\d{8}|\d{9})(?![\w-])", re.I), _NONE, False),
]


_CLAUSE_START = re.compile(r"[.!?]\s|\n")


def checked(valid, shown: str) -> bool:
    """Whether the checksum of a number holds, as written with spaces and hyphens."""
    try:
        return valid(re.sub(r"[\s-]", "", shown).upper())
    except (ValueError, IndexError):
        return False


def id_numbers(text: str, starts: list[int]) -> list[Found]:
    """Numbers of identity documents, tax and social insurance: form, checksum and nearby words."""
    out = []
    for (base, _, valid, strict), m in _matches(text, starts, _IDS, 3):
        sound = valid is not None and checked(valid, m.group())
        if strict and not sound:
            continue
        before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 25]
        before = _CLAUSE_START.split(before)[-1]
        score = base + (1.0 if sound else 0.0)
        if _ID_NEAR.search(before) or re.search(r"\b(?:ID|id)[ :#]*$", before):
            score += 2.0
        elif _ID_NEAR.search(after):
            score += 1.0
        if _NOT_NEAR.search(before) and not re.search(r"(?:tax|insurance|passport|social)", before, re.I):
            score -= 3.0
        out.append(Found("id_number", m.start(), m.end(), score))
    return [f for f in out if f.score >= 2.5]


# --- addresses -----------------------------------------------------------------------------------
_W = rf"{_L}(?:[\w'’-]*\w)?"
_ADDRESS = [
    (1.0, re.compile(rf"(?<![\w.,/-])\d{{1,5}}[ ]?[A-Za-z]?(?:-\d{{1,4}})? (?:{_W} ){{1,3}}?(?:{STREETS})\b(?! (?:map|of|for|to)\b)", re.I)),
    (2.0, re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[A-Za-z]))?,? (?:rue|avenue|boulevard|impasse|chemin|all[ée]e|quai|cours|route|ruelle|passage) (?:(?:du|de la|de|des) |de l['’]|d['’])?{_W}(?: {_L}\w*)??(?=[\s,.;\n]|$)", re.I)),
    (2.0, re.compile(rf"\b(?:calle|avenida|avda\.?|plaza|paseo|camino|carrer|via|viale|piazza|rua) (?:(?:de la|de los|de las|del|de|la|el) )?{_W}(?: {_W})?,? (?:n[.º°]? ?)?\d{{1,4}}[A-Za-z]?\b", re.I)),
    (2.0, re.compile(rf"\b{_L}[\w-]*(?:stra(?:ß|ss)e|str\.|allee|gasse|weg|platz|ring|damm|ufer|steig|chaussee|straat|laan|gatan|vej) \d{{1,4}}(?: ?[A-Za-z])?\b", re.I)),
]
_VIA = ("calle", "avenida", "avda", "plaza", "paseo", "camino", "carrer", "via", "piazza", "rua")
_WEG = ("str", "allee", "gasse", "weg", "platz", "ring", "damm", "ufer", "steig", "chaussee", "laan", "gatan", "vej")
_LIVES = re.compile(r"(?:\blives? at|\bliving at|\bresid\w+ at|\bship \b[^.\n]{0,40}\bto|\bsent to|\bmailed? to|\baddress(?: is)?:?|\bgeht an|\bwohn\w*\b[^.\n]{0,15}\bin|\banschrift:?|\bvive en|\benvi[óo] a|\bdirecci[óo]n:?|\bhabite(?: au)?|\badresse:?|\benvoy\w+ au|\bdelivered to|\bcolis [^.\n]{0,25}au)\s*$", re.I)
_CITY = re.compile(rf"\s*[,\n]\s*(?:\d{{4,5}} {_L}|{_L}[\w' -]{{1,30}},? \d{{4,5}})")


def _street_first(text: str, starts: list[int]):
    """Matches of the forms whose house number stands last."""
    seen = set()
    for n in starts:
        low = max(0, n - 70)
        before = text[low:n].lower()
        if not before.endswith((" ", ",", "º", "°", ".")):
            continue
        for form in _ADDRESS[2:]:
            if form is _ADDRESS[2] and not any(w in before for w in _VIA) or form is _ADDRESS[3] and not any(w in before for w in _WEG):
                continue
            for m in form[1].finditer(text, low, min(len(text), n + 8)):
                if m.end() > n and m.span() not in seen:
                    seen.add(m.span())
                    yield form, m


def addresses(text: str, starts: list[int]) -> list[Found]:
    """Street and house number."""
    out = []
    for (base, _), m in [*_matches(text, starts, _ADDRESS[:2], 0), *_street_first(text, starts)]:
        inner = m.group().split()
        if base == 1.0 and any(w.lower() in STOP for w in inner[1:-1]):
            continue
        before, after = text[max(0, m.start() - 70) : m.start()], text[m.end() : m.end() + 50]
        score = base
        if _LIVES.search(before):
            score += 2.0
        if _CITY.match(after):
            score += 2.0
        if base == 1.0 and len(inner) > 2 and all(w[0].isupper() for w in inner[1:]):
            score += 1.0
        if _NOT_NEAR.search(before):
            score -= 1.0
        out.append(Found("address", m.start(), m.end(), score))
    return [f for f in out if f.score >= 2.0]


# --- names ---------------------------------------------------------------------------------------
_FAM = rf"(?:[OoDd]['’]{_L}+|{_L}{{2,}}(?:['’]{_L}+)?)(?:-(?:[OoDd]['’])?{_L}{{2,}})*"
_GIV = rf"{_L}{{2,}}(?:-{_L}{{2,}})?"
_INI = rf"{_L}\."
_NAME = re.compile(
    rf"(?P<rev>(?:{PARTICLES} )?{_FAM}, (?:{_GIV}(?: {_INI}){{0,2}}|{_INI}(?: ?{_INI})?)(?![\w'’-]))"
    rf"|(?P<fwd>(?:{_GIV}|{_INI}(?: ?{_INI})?)(?: {_INI}){{0,2}} (?:{PARTICLES} )?{_FAM}(?![\w'’]))",
    re.I,
)
_TITLE = re.compile(rf"(?:{TITLES}\.?[ ]+)+", re.I)
_LEFT = re.compile(
    r"(?:\b(?:contact|speaker|speakers|moderator|host|author|presenter|sprecher(?:in)?|ponente|intervenante?|orateur|name|kontakt|contacto|attendee|autor(?:in)?)\s?[:：]\s*[\"“]?"
    r"|[\"“](?:attendee|name|speaker|contact|author|owner|user|person)[\"”]\s?:\s?[\"“]"
    r"|\b(?:made out to|issued (?:to|for)|thanks to|thank you to|cut by|edited by|reviewed by|recorded by|written by|presented by|signed by|my colleague|our colleague|colleague|on behalf of)\s+"
    r"|\b(?:ausgestellt für|dank an|rückfragen(?: bitte)? an|bitte an|kollege|kollegin|von frau|von herrn)\s+"
    r"|\b(?:gracias a|escriban a|escriba a|a nombre de|mi colega|nuestra colega)\s+"
    r"|\b(?:merci à|merci a|écrire à|écrivez à|au nom de|mon collègue|ma collègue)\s+"
    r"|(?:^|[\s:>])—\s?"
    r"|\bas\s+)$",
    re.I,
)
_RIGHT = re.compile(r"^\s?(?:,? (?:lives? at|told me|told us|will take|will answer|will present|wohnt|erzählte|vive en|habite)\b|\s*<|[\"”], [\"“](?:mail|email|phone)|,? unter \S+|,? en \S+(?:@| ?[\[(]at| at | @ )|, \S+(?:@| ?[\[(]at| at | @ ))", re.I)
_AS = re.compile(r"\bas\s+$", re.I)
_DASH = re.compile(r"—\s?$")
_DETERMINER = re.compile(r"\b(?:the|a|an|der|die|das|den|dem|le|la|les|el|los|un|une|una|our|this)\s+$", re.I)
_LINE_LEAD = re.compile(r"(?:^|\n)[ \t]*(?:[-*•>]\s*)?(?:[AQ]:\s*)?$")
#: What stands before and behind names, in lower case.
_LEFT_SEEDS = (
    "contact|speaker|speakers|moderator|host|author|presenter|sprecher|sprecherin|ponente|intervenant|intervenante|orateur|name|kontakt|contacto|attendee|autor|autorin|owner|user|person|"
    "made out to|issued to|issued for|thanks to|thank you to|cut by|edited by|reviewed by|recorded by|written by|presented by|signed by|colleague|on behalf of|"
    "ausgestellt für|dank an|rückfragen an|bitte an|kollege|kollegin|gracias a|escriban a|escriba a|a nombre de|colega|merci à|merci a|écrire à|écrivez à|au nom de|collègue|as|—|"
    "mr|mrs|ms|mx|miss|dr|prof|professor|doctor|herr|frau|hr|sr|sra|srta|señor|señora|don|doña|mme|mlle|monsieur|madame|sir|dame|ing|mag"
).split("|")
_RIGHT_SEEDS = (" lives at ", " live at ", " told me", " told us", " will take", " will answer", " will present", " wohnt ", " vive en ", " habite ")
_GAP = re.compile(r"[\s:：.\"“”]*")
_LINE = re.compile(r"(?:^|\n)[ \t]*(?:[-*•>]\s*)?(?:[AQ]:\s*)?(?=[^\s])")
_SENTENCE_START = re.compile(r"(?<!\b\w)(?<!\bmr)(?<!\bdr)(?<!\bprof)[.!?]\s+|\n|:\s", re.I)
_WORD_START = re.compile(r"(?<!\S)\S")
_FAMILY_BEFORE = re.compile(rf"(?:(?<!\w){PARTICLES} )?(?<![\w'’-]){_FAM}, $", re.I)


class Seeds:
    """Given names and the phrases beside names, found in one pass over a text."""

    def __init__(self, given: frozenset[str]):
        import ahocorasick

        self.given = given
        self.machine = ahocorasick.Automaton()
        for kind, group in (("right", _RIGHT_SEEDS), ("left", _LEFT_SEEDS), ("given", given)):
            for word in group:
                if word:
                    self.machine.add_word(word, (kind, word))
        self.machine.make_automaton()


def _hits(text: str, seeds: Seeds):
    """End and payload of every seed in the lower-cased text, positions as in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in text)
    for last, payload in seeds.machine.iter(low):
        yield last + 1, payload


_IS_PARTICLE = re.compile(PARTICLES, re.I)
_IS_INITIAL = re.compile(_INI)
_IS_TITLE = re.compile(rf"{TITLES}\.?", re.I)
_TITLE_BEFORE = re.compile(rf"\b{TITLES}\.? $", re.I)
_TITLES_BEFORE = re.compile(rf"(?:\b{TITLES}\.?\s+)+$", re.I)
_PARTICLE_IN = re.compile(rf" {PARTICLES} ", re.I)
_INITIAL_IN = re.compile(rf"(?:^| ){_INI} ")
_MIDDLE_INITIAL = re.compile(rf"{_L}{{2,}} {_INI} ")
_NEXT_WORD = re.compile(rf"\s+({_L}+)")
_FIRST_WORD = re.compile(rf"{_L}+(?![.'’-])")
_ON_LINE = re.compile(r"[ \t]*(?:\n|$)")
_NEXT_LINE = re.compile(r"[ \t]*\n+[ \t]*(?:[-*•>]\s*)?(?:[AQ]:\s*)?")
_TOLD, _COMMA, _HASH = re.compile(r"\s*told\b"), re.compile(r",\s"), re.compile(r"#\s*$")


_OPENS = re.compile(r"^$|[.!?:]\s+$|\n\s*$")


def _whole_name(text: str, start: int, cased: bool, given: frozenset[str]) -> int:
    """Where a name that a phrase ends begins: further given and family names and particles before it.

    Words are taken back to the first that cannot be part of a name; of them the earliest known given name
    begins the name; of capitalized ones the first if they are several; in lower case the first if it begins a
    sentence, whose subject they then are.
    """
    at, taken = start, []
    while at and text[at - 1] == " ":
        begin = at - 1
        while begin and (text[begin - 1].isalpha() or text[begin - 1] in "'’-"):
            begin -= 1
        word = text[begin : at - 1]
        low = word.lower()
        if len(word) < 2 or begin and not text[begin - 1].isspace() or low in PRODUCTS or _IS_TITLE.fullmatch(word):
            break
        if not _IS_PARTICLE.fullmatch(word) and (low in STOP or cased and not word[0].isupper()):
            break
        taken.append((begin, low, bool(_IS_PARTICLE.fullmatch(word))))
        at = begin
    while taken and taken[-1][2]:
        taken.pop()
    known = [b for b, low, _ in taken if low in given]
    if known:
        return known[-1]
    opens = bool(taken) and _OPENS.search(text[max(0, taken[-1][0] - 3) : taken[-1][0]]) is not None
    return taken[-1][0] if (sum(not p for _, _, p in taken) > 1 if cased else opens) else start


def names(text: str, seeds: Seeds, marks: list[Found]) -> list[Found]:
    """Given name or initial and family name, any order, without title.

    A name is proposed behind every title, left context, line start and known given name, and before
    every right context; ``marks`` are the details found before, since a name on a line of its own
    above an address counts.
    """
    given = seeds.given
    starts: set[int] = set()
    told = "told" in text
    for end, (kind, word) in _hits(text, seeds):
        # "as" counts only where somebody told something
        if word == "as" and not told:
            continue
        begin = end - len(word)
        if kind == "given":
            if (begin and text[begin - 1].isalnum()) or text[end : end + 1].isalnum():
                continue
            starts.add(begin)
            # a family name may stand before
            low = max(0, begin - 60)
            back = _FAMILY_BEFORE.search(text, low, begin)
            if back:
                starts.add(back.start())
        elif kind == "left":
            if not begin or not text[begin - 1].isalnum():
                starts.add(_GAP.match(text, end).end())
        else:
            low = max(0, begin - 60)
            line = _SENTENCE_START.split(text[low:begin])[-1]
            starts.update(sorted(begin - len(line) + k.start() for k in _WORD_START.finditer(line))[-5:])
    starts.update(m.end() for m in _LINE.finditer(text))
    at_mark = {f.start for f in marks}
    found = []
    for s in sorted(starts):
        head = _FIRST_WORD.match(text, s)
        if head and head.group().lower() in STOP:
            continue
        t = _TITLE.match(text, s)
        titled = False
        if t and t.end() < len(text):
            s, titled = t.end(), True
        m = _NAME.match(text, s)
        if not m:
            continue
        start, end = m.start(), m.end()
        value = m.group()
        toks = [w for w in re.split(r"[ ,]+", value) if w]
        solid = [w for w in toks if not _IS_PARTICLE.fullmatch(w) and not _IS_INITIAL.fullmatch(w)]
        if any(w.lower() in STOP or w.lower() in PRODUCTS for w in solid) or not solid:
            continue
        if m.group("rev") is None and _IS_TITLE.fullmatch(toks[0]):
            continue
        titled = titled or bool(_TITLE_BEFORE.search(text[max(0, s - 12) : s]))
        cased = all(w[0].isupper() for w in solid)
        before, after = text[max(0, start - 60) : start], text[end : end + 60]
        lead = _TITLES_BEFORE.sub("", before)
        first = (toks[-1] if m.group("rev") else toks[0]).lower().strip(".")
        if m.group("rev"):
            first = re.split(r", ?", value)[1].split()[0].lower().strip(".")
        score = 0.0
        known = first in given
        score += 2.0 if known else 0.0
        left, right = _LEFT.search(lead), _RIGHT.match(after)
        if left and _AS.search(lead):
            left = left if _TOLD.match(after) else None
        if left and _DASH.search(lead) and not (cased or known or _COMMA.match(after)):
            left = None
        score += 3.0 if left else 0.0
        score += 2.0 if titled else 0.0
        score += 3.0 if right else 0.0
        score += 1.0 if cased else 0.0
        score += 0.5 if m.group("rev") or "-" in value or _PARTICLE_IN.search(value) or _INITIAL_IN.search(value) else 0.0
        lined = bool(_LINE_LEAD.search(lead)) and bool(_ON_LINE.match(after))
        follows = _NEXT_LINE.match(after)
        if lined and follows and end + follows.end() in at_mark:
            score += 2.5
        elif lined and (known or m.group("rev")) and cased:
            score += 1.0
        nxt = _NEXT_WORD.match(after)
        if nxt and nxt.group(1).lower() in PRODUCTS:
            score -= 3.0
        if not left and not titled and _DETERMINER.search(lead):
            score -= 3.0
        if _HASH.search(before):
            score -= 3.0
        if not cased and not (left or titled or right or (lined and follows)):
            score -= 2.0
        if score >= 3.0:
            # in lower case a word before an initial may belong to the sentence before
            if not cased and not known and not left and not titled and _MIDDLE_INITIAL.match(value):
                score -= 0.75
            if right and not left and not titled and m.group("rev") is None:
                longer = _whole_name(text, start, cased, given)
                score += 0.25 if longer < start else 0.0
                start = longer
            found.append(Found("name", start, end, score))
    return found


_ORDER = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def details(text: str | None, seeds: Seeds) -> list[Found]:
    """All details of a text in order, none overlapping another: the surer, then the longer stays."""
    if not text:
        return []
    starts = _number_starts(text)
    marks = emails(text) + phones(text, starts) + id_numbers(text, starts) + addresses(text, starts)
    every = marks + names(text, seeds, marks)
    every.sort(key=lambda f: (-f.score if f.kind != "email" else -9, -(f.end - f.start), _ORDER[f.kind], f.start))
    taken: list[Found] = []
    used = bytearray(len(text) + 1)
    for f in every:
        if not any(used[f.start : f.end]):
            used[f.start : f.end] = b"\x01" * (f.end - f.start)
            taken.append(f)
    return sorted(taken, key=lambda f: f.start)


def redact(text: str | None, found: list[Found]) -> str | None:
    """The text with every detail replaced by a placeholder of its kind."""
    if text is None:
        return None
    out, at = [], 0
    for f in found:
        out += [text[at : f.start], PLACEHOLDER[f.kind]]
        at = f.end
    return "".join([*out, text[at:]])
