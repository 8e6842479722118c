"""Signals about one question and answer pair, as plain Python for Arrow-batched functions."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

from talkgrid.functions.text import plain, same_word, words
from talkgrid.llm.functions.languages import Languages

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in on at for with by from as is are was were be been it its this that these those they them we you i he she not but which what how why who when where does do did has have had because after before than then so can could would should there their our your",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber von zu zum zur im in am an auf für mit bei beim nach aus als ist sind war waren wird wurde wurden werden es sich nicht dass weil wie was warum welche welcher welches wer wann wo er sie wir ich ihr man noch nur alles alle dazu laut hat haben zwischen vor allem zu oft seine seinen ihre danach",
    "es": "el la los las un una unos unas y o pero de del al en con por para como es son fue fueron se que qué no su sus lo le les este esta estos estas ese esa cómo cuál quién cuándo dónde porque según después antes muy más ya todo cada entre sin a menudo solo",
    "fr": "le la les un une des et ou mais de du au aux en dans avec par pour comme est sont était étaient se que qui quoi ne pas son sa ses leur leurs ce cet cette ces il elle ils elles nous vous je on parce selon après avant très plus tout tous chaque entre sans comment pourquoi quand où y a été sur souvent",
}
#: Frequent function words of further languages, which have no training texts here.
FURTHER_WORDS = {
    "it": "il lo gli della delle degli dei nel nella che è sono era erano perché anche più questo questa questi queste non si mi ma quando dove chi di da dal dalla alla al ogni tra senza",
    "nl": "het een van en niet met voor zijn wordt worden werd deze dit dat ook omdat maar naar bij aan hij zij wij waarom hoe wat waar wanneer niet meer ze geen",
    "pt": "os uma não são foi foram porque também isso esta este estas estes dos das nos nas pelo pela mais quando onde quem ele ela eles elas cada sem entre",
}
_MAIN = frozenset(w for v in FUNCTION_WORDS.values() for w in v.split())
_FUNCTION = {lang: frozenset(v.split()) for lang, v in FUNCTION_WORDS.items()} | {lang: frozenset(v.split()) - _MAIN for lang, v in FURTHER_WORDS.items()}
#: Letters that speak for a language.
LETTERS = {"de": "äöüß", "es": "ñ¿¡áíóú", "fr": "àâçêëîïôœùû"}
#: Words that no complete sentence ends with.
DANGLING = frozenset(
    "the a an and or of to in on at for with by from as is are was were be been its this that these those because than then which such "
    "der die das den dem ein eine einen einem einer und oder von zu zum zur im am auf für mit bei beim nach aus als dass weil "
    "el la los las un una y o de del al en con por para como que su se le les des et ou du au aux dans avec par pour qui".split()
)
#: Texts that stand for nothing.
PLACEHOLDERS = frozenset("na|n a|none|null|nil|nan|no answer|answer|empty|tbd|todo|unknown answer|not available|keine antwort|sin respuesta|ninguna|keine|antwort|respuesta|réponse|blank".split("|"))
_PLACEHOLDER_WORDS = frozenset(w for p in PLACEHOLDERS for w in p.split())
#: How answers decline.
REFUSALS = [
    r"\bi (?:am|'m) (?:sorry|unable|not able|afraid)\b|\bi'?m sorry\b|^sorry\b|\bapologi[sz]e\b",
    r"\b(?:can(?:no|')t|can not|could not|couldn'?t|unable to|not able to|won'?t|must decline to|must decline|decline to|will abstain|abstain)\b",
    r"\bi (?:do not|don'?t) (?:know|have (?:enough|sufficient|any|access))\b",
    r"\bno (?:relevant|suitable|sufficient|matching)? ?(?:information|answer|evidence|passage|context|talk)\b.*\b(?:found|available|provided|determined|addresses|covers|exists?)\b|\bno answer (?:could|can)\b",
    r"\bnot (?:enough|sufficient) (?:evidence|information|context)\b|\binsufficient (?:evidence|information|context)\b|\bnot (?:covered|answered|addressed|mentioned) (?:by|in)\b|\b(?:do|does) not (?:address|contain|cover|mention|answer)\b",
    r"\bthere (?:is|was) (?:nothing|no\b)|\b(?:it is|it's|it was) (?:not|im)\s?possible\b|\bnothing (?:in|about) (?:the|this)\b|\bit is not (?:clear|possible|known|stated)\b|\bcould not find\b",
    r"\bas an? (?:ai|language model|assistant)\b|\boutside (?:of )?what i\b|\bcan'?t be answered\b|\bcannot be answered\b",
    r"\b(?:leider|kann ich|können wir)\b.*\b(?:nichts|nicht|keine)\b|\bkeine (?:antwort|angaben|information)|\bweiß ich (?:leider )?nicht\b|\bich weiß (?:es )?nicht\b",
    r"\blo siento\b|\bno (?:puedo|podemos|sé|se puede|tengo|dispongo)\b|\bno hay (?:información|datos)\b",
    r"\bmi dispiace\b|\bnon (?:posso|possiamo|so|è possibile)\b|\bhelaas\b|\bik (?:weet|kan) (?:het )?niet\b|\bnão (?:posso|sei|é possível)\b",
    r"\bdésolée?\b|\bje ne (?:peux|sais|suis)\b|\bimpossible de répondre\b|\baucune (?:information|réponse)\b",
]
_REFUSAL = [re.compile(p) for p in REFUSALS]
_BUT = re.compile(r"\b(?:but|however|aber|jedoch|pero|sin embargo|mais|cependant)\b")
_PREFACE = re.compile(r"^(?:asked about|regarding|on the question|zur frage|sobre la pregunta)\b[^.!?\n]{0,200}\b(?:as follows|folgendes|lo siguiente)\s*[.:]\s*", re.I)
_LABEL = re.compile(r"^\s*(?:\*\*|__|#+\s*)?(?:question|answer|q|a|response|frage|antwort|pregunta|respuesta|réponse)\s*[:：]\s*(?:\*\*|__)?", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|[*_`#>|~]+")
_SENTENCE = re.compile(r"(?<=[.!?。…])[\"'”’»)\]*]*\s+")
_TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*$")
_FENCED = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
_ANSWER_KEY = re.compile(r"[\"']answer[\"']\s*:\s*", re.I)
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("?)', re.S)


def answer_in_raw(raw: str | None) -> tuple[str, bool]:
    """The answer that a raw response holds, and whether its string breaks off before it is closed.

    The first string under an ``answer`` key counts; ``null`` there is no answer.  Without such a key
    and without any JSON the whole response, fences stripped, is the answer.
    """
    if not raw:
        return "", False
    key = _ANSWER_KEY.search(raw)
    if key is None:
        rest = _FENCED.sub("", raw).strip()
        return ("", False) if rest[:1] in "{[" else (rest, False)
    m = _STRING.match(raw, key.end())
    if m is None:
        return "", False
    body, closed = m.group(1), bool(m.group(2))
    for cut in (body, body[:-1], re.sub(r"\\u[0-9a-fA-F]{0,3}$", "", body)):
        try:
            return json.loads(f'"{cut}"', strict=False), not closed
        except ValueError:
            continue
    return body, not closed


def language(tokens: list[str]) -> str | None:
    """The language whose function words stand out among the tokens, or None."""
    score = {lang: sum(t in own for t in tokens) for lang, own in _FUNCTION.items()}
    best, second = sorted(score.values(), reverse=True)[:2]
    if best < 2 or best < 1.4 * second + 0.1:
        return None
    return next(lang for lang in score if score[lang] == best)


def script_hint(text: str) -> str | None:
    """The language that the special letters of a text speak for, or None."""
    low = text.lower()
    score = {lang: sum(low.count(ch) for ch in letters) for lang, letters in LETTERS.items()}
    best, second = sorted(score.values(), reverse=True)[:2]
    return None if best == 0 or best == second else next(lang for lang in score if score[lang] == best)


def repeats(question: list[str], answer: list[str]) -> bool:
    """Whether the answer holds the question's words, once or again, and next to nothing else."""
    if len(question) < 3 or not answer:
        return False
    rest = list(question)
    extra = 0
    for w in answer:
        hit = w if w in rest else next((v for v in rest if same_word(w, v)), None)
        if hit is not None:
            rest.remove(hit)
        elif w not in question:
            extra += 1
    return len(rest) <= 0.2 * len(question) and extra <= max(1, 0.25 * len(answer))


def unbalanced(text: str) -> bool:
    """An opened fence, bracket or quotation that is never closed."""
    if text.count("```") % 2 or text.count("(") > text.count(")") or text.count("[") > text.count("]"):
        return True
    bare = re.sub(r"\d\s*\"", "", text)
    return bare.count('"') % 2 == 1 or text.count("“") > text.count("”") or text.count("„") > text.count("“") + text.count("”")


def open_tail(text: str) -> bool:
    """Prose whose last sentence has no end, short names, lists and closed quotations apart."""
    body = text.rstrip()
    if not body or _TERMINAL.search(body) or body.endswith("```"):
        return False
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    bullets = [x for x in lines if re.match(r"[-*•]\s", x)]
    if len(bullets) > 1 and lines[-1] == bullets[-1]:
        # a list is broken off when its other items end and the last one does not
        return bool(_TERMINAL.search(bullets[-2])) and not body.endswith((")", '"', "”"))
    numbered = [x for x in lines if re.match(r"\d+[.)]\s", x)]
    if len(numbered) > 1 and lines[-1] == numbered[-1]:
        return bool(_TERMINAL.search(numbered[-2]))
    parts = _SENTENCE.split(body)
    if body.endswith((")", '"', "”", "»", "]")):
        return False
    if len(parts) == 1:
        return len(parts[0].split()) > 6
    return True


def dangling_end(text: str) -> bool:
    """Ends in a comma, dash, opening sign or a word that wants another."""
    body = text.rstrip()
    if not body:
        return False
    if body[-1] in ",;-–—([{/&+=“„":
        return len(body.split()) > 1
    if re.search(r"(?:\.\.\.|…)$", body) and len(body.split()) > 2:
        return True
    if _TERMINAL.search(body):
        return False
    bare = re.sub(r"[\"'”’»)\]*_.!?…]+$", "", body)
    last = re.findall(r"[^\W\d_]+", bare[-40:].lower())
    if len(bare.split()) <= 2 or not last or not bare.lower().endswith(last[-1]):
        return False
    return last[-1] in DANGLING


def in_order(question: list[str], answer: list[str]) -> bool:
    """Whether the words of the question make up the answer in their order."""
    return len(question) > 2 and bool(answer) and SequenceMatcher(None, question, answer, autojunk=False).ratio() >= 0.75


#: Order of the votes of ``signals``: (defect, labelling function, what it votes for).  No function is the negation of another.
VOTES = [
    ("empty", "no_letters", 1), ("empty", "placeholder", 1), ("empty", "has_words", 0),
    ("truncated", "unbalanced", 1), ("truncated", "open_tail", 1), ("truncated", "dangling", 1), ("truncated", "unclosed_json", 1), ("truncated", "ends_well", 0),
    ("refusal", "declines", 1), ("refusal", "flag", 1), ("refusal", "says_more", 0),
    ("copy", "repeats", 1), ("copy", "in_order", 1), ("copy", "asks", 1),
    ("language", "function_words", 1), ("language", "letters", 1), ("language", "letter_groups", 1), ("language", "unlike", 1), ("language", "same_language", 0),
]


def signals(question: str | None, answer: str | None, abstain: bool | None, parse_ok: bool | None, raw: str | None, languages: Languages | None = None) -> list[bool]:
    """Which labelling functions fire, in the order of ``VOTES``."""
    text, broken = answer, False
    if parse_ok is False:
        text, broken = answer_in_raw(raw)
        if not text and answer and raw is None:
            text = answer
    shown = plain(text).strip()
    seen = text.strip() if text else ""
    bare = _MARKUP.sub(" ", _LABEL.sub("", shown)).strip()
    letters = re.sub(r"[\W_]+", " ", bare).strip()
    no_letters, placeholder = not letters, letters in PLACEHOLDERS
    nothing = no_letters or placeholder
    core = _PREFACE.sub("", _LABEL.sub("", seen)).strip()
    tokens, asked = words(core), words(question)
    label_free = words(_LABEL.sub("", bare))
    same = repeats(asked, label_free)

    sentences = [s for s in _SENTENCE.split(plain(core).strip()) if s]
    declining = [any(p.search(s) for p in _REFUSAL) for s in sentences]
    # what follows a "but" is said nevertheless, unless it declines as well
    after = [_BUT.split(s)[-1] if _BUT.search(s) else "" for s in sentences]
    heads = [d and (len(t.split()) <= 4 or any(p.search(t) for p in _REFUSAL)) for d, t in zip(declining, after)]
    said = [len(s.split()) for s, h in zip(sentences, heads) if not h]
    says_more = sum(said) > 10 or any(n > 8 for n in said)
    declines = bool(heads) and heads[0]
    only = declines and not says_more

    lang_q, lang_a = language(asked), language(tokens)
    hint = script_hint(core)
    differs = lang_q is not None and lang_a is not None and lang_a != lang_q
    hinted = lang_q is not None and hint is not None and hint != lang_q and lang_a in (None, hint)
    grouped = unlike = False
    usable = not nothing and not same
    if languages is not None and usable and not only and question:
        grouped, unlike = languages.differs(languages.best(question), core), languages.unlike(core)

    loose, tail, dangle = usable and unbalanced(seen), usable and open_tail(core), usable and dangling_end(core)
    ends_well = bool(_TERMINAL.search(core)) and not loose and not dangle
    return [
        no_letters, placeholder, sum(w not in _PLACEHOLDER_WORDS for w in label_free) > 1,
        loose, tail and not only, dangle, broken and usable, ends_well and not broken,
        declines and not nothing, bool(abstain) and not nothing and not says_more, says_more,
        same and not nothing, not nothing and in_order(asked, label_free), len(label_free) > 3 and bare.rstrip(" \"'”*_").endswith("?"),
        usable and differs and not only, usable and hinted and not only, grouped, unlike, lang_q is not None and lang_a == lang_q,
    ]
