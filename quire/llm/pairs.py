"""Problem 3: broken prompt and response pairs, each with its kind of defect.

A pushdown parser over fences, brackets, quotations, lists and markup finds answers that end with something open (and
reads answer texts out of broken JSON); words that all other answers go on after, and beginnings of known words, tell
those that end in the middle of a sentence or word. A refusal grammar, greedy string tiling of the answer with the
question, and script and function-word checks of both languages find the rest.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import checkpointed

# ---------------------------------------------------------------------------------------------- pushdown parser

OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
CLOSERS = {")", "]", "}", "”", "»"}
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "wbr"}
EMPHASIS = ("**", "__", "~~")
TAG = regex.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*)?(/?)>|<[A-Za-z/][^<>]*\Z")
ITEM = regex.compile(r"([ \t]*)(?:([-*•])|(\d{1,3}|[a-z])([.)]))(?:[ \t]+(?=\S)|[ \t]*(?=\n|\Z))")
#: Marks after which something has to come, and words of which the same holds.
PROMISES = frozenset(",;:–—/&+=…")
#: English words that no sentence ends in.
NEVER_LAST = frozenset("a an the of and or but nor because while whereas although unless if than with from by for at into onto upon among between during within without under per via our their its his my your is are was were be been being has have had will would shall should may might must can could which whose".split())
ENDING = regex.compile(r"[.!?;:。！？؟]")


class Rows:
    """The list items and table rows of a text, line by line: items by their indent on a stack, a table as its cells."""

    def __init__(self) -> None:
        self.items: list[tuple[int, str, list[str]]] = []  # indent, kind of marker, contents so far
        self.cells = 0

    def line(self, text: str) -> None:
        bare = text.strip()
        if bare.startswith("|"):
            closed = bare.endswith("|") and len(bare) > 1
            count = bare.count("|") - 1 if closed else 0
            self.cells = max(self.cells, count)
            self.row_open = not closed or count < self.cells
            return
        self.row_open = False
        if bare:
            self.cells = 0
        marker = ITEM.match(text)
        if marker:
            indent, kind = len(marker.group(1).expandtabs(4)), marker.group(2) or ("1" if marker.group(3).isdigit() else "a") + marker.group(4)
            while self.items and (self.items[-1][0] > indent or self.items[-1][0] == indent and self.items[-1][1] != kind):
                self.items.pop()
            if not self.items or self.items[-1][0] < indent:
                self.items.append((indent, kind, []))
            self.items[-1][2].append(text[marker.end() :].strip())
        elif bare and self.items:
            if text[:1].isspace():
                self.items[-1][2][-1] += " " + bare  # an item goes on
            else:
                self.items.clear()
        elif not bare:
            self.row_open = False

    def open(self) -> list[str]:
        """`row` of fewer cells than those above it or without its end; `item` that is empty, of words only that promise
        more, or without the stop that all items above it have."""
        found = ["row"] if getattr(self, "row_open", False) else []
        if self.items:
            *above, last = self.items[-1][2]
            words = regex.findall(r"\p{L}+", last.lower())
            stopped = [bool(ENDING.search(x[-1:])) for x in above]
            if (not last and (above or len(self.items) > 1)) or words and NEVER_LAST.issuperset(words) and above or len(above) > 1 and all(stopped) and not ENDING.search(last[-1:]):
                found.append("item")
        return found


def open_at_end(text: str) -> list[str]:
    """What `text` leaves open, outermost first: fences, code spans, emphasis, brackets, quotations, tags, list items, table
    rows, and `more` after a mark that something has to follow.

    Inside a fence or code span nothing else counts. A closing mark pops back to its opener; one without an opener is
    ignored, as in `1)` or `:)`. Apostrophes and inch marks are no quotations: a straight double quote opens only
    before a word and after a gap; so does emphasis, and it closes after a word.
    """
    stack: list[str] = []
    rows, fenced, promised = Rows(), False, False
    i, n, line = 0, len(text), 0
    while i < n:
        c = text[i]
        if text.startswith("```", i):
            stack.pop() if stack and stack[-1] == "```" else stack.append("```")
            i, fenced, promised = i + 3, True, False
            continue
        if stack and stack[-1] == "```":
            i += 1
            continue
        if c == "\n":
            if not fenced:
                rows.line(text[line:i])
            line, fenced = i + 1, False
        if c == "`":
            stack.pop() if stack and stack[-1] == "`" else stack.append("`")
        elif stack and stack[-1] == "`":
            pass
        elif text[i : i + 2] in EMPHASIS:
            mark = text[i : i + 2]
            if mark in stack and i and not text[i - 1].isspace():
                while stack.pop() != mark:
                    pass
            elif i + 2 < n and not text[i + 2].isspace() and text[i + 2] not in "*_~" and (i == 0 or not text[i - 1].isalnum()) or i + 2 == n and i and text[i - 1].isspace():
                stack.append(mark)
            i += 2
            continue
        elif c == "<" and (tag := TAG.match(text, i)):
            if tag.group(2) is None:
                stack.append("<")
            elif tag.group(1):
                if f"<{tag.group(2).lower()}>" in stack:
                    while stack.pop() != f"<{tag.group(2).lower()}>":
                        pass
            elif not tag.group(3) and tag.group(2).lower() not in VOID_TAGS:
                stack.append(f"<{tag.group(2).lower()}>")
            i = tag.end()
            continue
        elif c == '"':
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            elif i + 1 < n and not text[i + 1].isspace() and (i == 0 or not text[i - 1].isalnum()):
                stack.append('"')
            elif i + 1 == n and i and text[i - 1].isspace():
                stack.append('"')
        elif c in CLOSERS or (c == "“" and "„" in stack):
            match = next((k for k in range(len(stack) - 1, -1, -1) if OPENERS.get(stack[k]) == c), None)
            if match is not None:
                del stack[match:]
            elif c in OPENERS:
                stack.append(c)
        elif c in OPENERS:
            stack.append(c)
        if c in PROMISES or text.startswith("...", i) or c == "-" and i and text[i - 1].isspace():
            promised = True
            i += 2 * text.startswith("...", i)
        elif not c.isspace() and c not in "\"'”’»":
            promised = False
        i += 1
    if not fenced:
        rows.line(text[line:])
    return stack + rows.open() + ["more"] * promised


def _unescaped(body: str) -> str:
    """The string that JSON writes as `body`, which may end within an escape."""
    for end in range(len(body), max(-1, len(body) - 7), -1):
        try:
            return json.loads(f'"{body[:end]}"', strict=False)
        except ValueError:
            continue
    return body


def json_texts(raw: str | None) -> tuple[list[str], bool]:
    """The claims' texts in `raw`, whole JSON or cut off anywhere, and whether it ends inside one of them."""
    if not raw or not raw.strip():
        return [], False
    try:
        parsed = json.loads(raw)
        claims = parsed.get("claims") if isinstance(parsed, dict) else None
        own = [c.get("text") for c in claims if isinstance(c, dict)] if isinstance(claims, list) else []
        if isinstance(parsed, dict) and isinstance(parsed.get("answer"), str):
            own = own or [parsed["answer"]]
        return [t for t in own if isinstance(t, str)], False
    except ValueError:
        pass
    texts, i, key, n = [], 0, None, len(raw)
    while i < n:
        if raw[i] != '"':
            i += 1
            continue
        j = i + 1
        while j < n and raw[j] != '"':
            j += 2 if raw[j] == "\\" else 1
        body, closed = raw[i + 1 : min(j, n)], j < n
        after = raw[j + 1 :].lstrip()[:1] if closed else ""
        if closed and after == ":":
            key = body
        elif key in ("text", "answer"):
            texts.append(_unescaped(body))
            if not closed:
                return texts, True
            key = None
        i = j + 1
    return texts, False


# ---------------------------------------------------------------------------------------------- refusals

#: The refusal grammar, over lower-case words, symbols in capitals; `^` begins a sentence or clause. A symbol with ? may be left out, one with *
#: may be repeated. Whoever declines is the one who answers: what others cannot do or say is no refusal.
GRAMMAR = {
    "REFUSAL": ("APOLOGY", "DECLINING", "PREFERENCE", "INABILITY", "PASSIVE", "OUTSIDE", "LACK", "^ as an? PERSONA", "please REFERRAL", "FOREIGN"),
    "APOLOGY": ("^ OWN_STATE? DEGREE* sorry but? SUBJECT",),
    "OWN_STATE": ("i'm", "i am", "we are", "we're"),
    "SUBJECT": ("i", "we", "this", "that", "the", "no"),
    "SPEAKER": ("i", "we", "this ROLE", "the ROLE"),
    "ROLE": ("assistant", "model", "system", "chatbot"),
    "DECLINING": ("SPEAKER DUTY? DEGREE* REFUSE", "^ must REFUSE", "SPEAKER_IS going to REFUSE"),
    "DUTY": ("must", "have to", "will have to", "will", "would", "should", "shall"),
    "REFUSE": ("decline to SPEECH", "refuse to SPEECH", "decline ^", "refuse ^", "decline this", "decline that"),
    "PREFERENCE": ("SPEAKER would? DEGREE* rather not SPEECH", "SPEAKER would? DEGREE* prefer not to SPEECH", "SPEAKER would? DEGREE* choose not to SPEECH", "i'd DEGREE* rather not SPEECH", "i'd DEGREE* prefer not to SPEECH"),
    "INABILITY": ("SPEAKER DEGREE* CANNOT DEGREE* SPEECH", "SPEAKER_IS DEGREE* UNABLE SPEECH", "^ DEGREE* UNABLE SPEECH", "^ CANNOT SPEECH", "it is not possible FOR_ME? to SPEECH", "it's not possible FOR_ME? to SPEECH"),
    "SPEAKER_IS": ("i am", "i'm", "we are", "we're", "this ROLE is", "the ROLE is", "i was", "we were"),
    "FOR_ME": ("for me", "for us"),
    "CANNOT": ("cannot", "can not", "can't", "could not", "couldn't", "won't", "will not", "am not able to", "are not able to"),
    "UNABLE": ("unable to", "not able to", "not permitted to", "not allowed to", "not in a position to"),
    "PASSIVE": ("no answer MODAL be GIVEN", "an answer CANNOT be GIVEN", "THING? CANNOT be GIVEN PREPOSITION SOURCE"),
    "THING": ("question", "request", "answer", "this", "that", "it"),
    "MODAL": ("can", "could", "may"),
    "GIVEN": ("provided", "given", "found", "determined", "answered", "established"),
    "PREPOSITION": ("from", "on", "with", "by", "based on", "using"),
    "OUTSIDE": ("BEYOND of? what OWN", "BEYOND of? my", "BEYOND of? the scope of my", "BEYOND of? the scope of SOURCE", "BEYOND of? the scope of what OWN"),
    "BEYOND": ("beyond", "outside"),
    "OWN": ("i", "we", "the ROLE", "this ROLE"),
    "LACK": ("SOURCE FOUND? DO_NOT DEGREE* TELL", "SOURCE FOUND? DO_NOT DEGREE* HOLD SOME? MATTER", "SPEAKER DO_NOT DEGREE* have SOME? MATTER", "SPEAKER LACK SOME? MATTER", "there is SCARCE MATTER", "there was SCARCE MATTER", "^ SCARCE MATTER", "no MATTER was found", "no MATTER is available", "no MATTER in SOURCE"),
    "SOURCE": ("DET KIND? DOCUMENT", "DET KIND? DOCUMENT provided"),
    "DET": ("the", "these", "this", "those", "your", "given"),
    "KIND": ("given", "provided", "available", "retrieved", "supplied", "source", "above"),
    "DOCUMENT": ("passages", "passage", "context", "documents", "document", "sources", "source", "excerpts", "excerpt", "evidence", "texts", "text", "materials", "material", "pages"),
    "FOUND": ("found", "given", "provided", "above", "retrieved", "supplied"),
    "DO_NOT": ("do not", "does not", "did not", "don't", "doesn't", "didn't"),
    "TELL": ("say", "state", "mention", "tell", "answer", "cover", "address", "specify"),
    "HOLD": ("contain", "provide", "include", "hold", "give", "offer", "have"),
    "SOME": ("enough", "sufficient", "any", "the necessary", "the required", "the requested", "the relevant", "relevant"),
    "SCARCE": ("not enough", "insufficient", "no sufficient", "no supporting", "a lack of", "lack of"),
    "MATTER": ("evidence", "information", "data", "details", "access", "context", "support"),
    "PERSONA": ("ai", "artificial intelligence", "language model", "assistant", "ai language model", "large language model", "ai assistant", "ai model"),
    "REFERRAL": ("ask a qualified", "ask a professional", "consult a qualified", "consult a professional", "consult a financial", "contact a qualified", "contact a professional", "ask a financial", "ask a licensed", "consult a licensed"),
    "SPEECH": ("answer", "help", "assist", "discuss", "provide", "give", "state", "say", "tell", "share", "comply", "determine", "find", "respond", "offer", "disclose", "comment", "confirm", "speculate"),
    "DEGREE": ("very", "so", "truly", "really", "respectfully", "unfortunately", "therefore", "also", "simply", "much", "currently", "still"),
    "FOREIGN": (
        "je suis désolé", "je suis désolée", "je ne peux pas", "je ne suis pas en mesure", "je dois refuser", "ne contiennent pas assez", "ne contient pas assez", "ne contiennent pas suffisamment", "ne contient pas suffisamment",
        "ne permettent pas de répondre", "ne permet pas de répondre", "ne contiennent pas d'éléments", "ne contient pas d'éléments", "es tut mir leid", "ich kann das", "ich kann diese", "ich kann dazu", "ich kann ihnen", "ich kann leider", "leider kann ich", "dazu kann ich",
        "leider ist es mir", "dazu ist es mir", "nicht genügend belege", "nicht genügend angaben", "nicht genügend informationen", "keine ausreichenden", "lo siento", "no puedo responder", "no puedo ayudar", "no puedo dar", "no puedo facilitar", "no puedo indicar",
        "no contienen suficiente", "no contienen suficientes", "no contiene suficiente", "no contiene suficientes", "no hay suficiente", "no hay suficientes", "no contienen pruebas", "no hay pruebas", "no contienen información suficiente", "no hay información suficiente",
        "mi dispiace", "non posso rispondere", "non posso aiutare", "non posso fornire", "non contengono prove sufficienti", "non contengono informazioni sufficienti", "het spijt me", "ik kan deze", "ik kan daar", "ik kan dit", "onvoldoende bewijs", "onvoldoende informatie",
    ),
}
RULES = {symbol: tuple(way.split() for way in ways) for symbol, ways in GRAMMAR.items()}
TOKENS = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:'[\p{L}]+)*|[.!?;:,\n]")


@lru_cache(maxsize=None)
def beginnings(symbol: str) -> frozenset[str]:
    """The words that `symbol` may begin with."""
    if symbol not in RULES:
        return frozenset((symbol,))
    found: set[str] = set()
    for way in RULES[symbol]:
        for part in way:
            found |= beginnings(part.rstrip("?*"))
            if part[-1] not in "?*":
                break
    return frozenset(found)


def derived(symbol: str, words: list[str], at: int) -> set[int]:
    """Where `symbol` may end if it begins at `at`."""
    if symbol == "an?":
        return {at + 1} if at < len(words) and words[at] in ("a", "an") else set()
    if symbol[-1] in "?*":
        ends, todo = {at}, [at]
        while todo:
            new = derived(symbol[:-1], words, todo.pop()) - ends
            ends |= new
            todo += new if symbol[-1] == "*" else ()
        return ends
    if symbol not in RULES:
        return {at + 1} if at < len(words) and words[at] == symbol else set()
    if at >= len(words) or words[at] not in beginnings(symbol) and "^" not in beginnings(symbol):
        return set()
    ends = set()
    for way in RULES[symbol]:
        places = {at}
        for part in way:
            places = {end for place in places for end in derived(part, words, place)}
            if not places:
                break
        ends |= places
    return ends


def is_refusal(text: str) -> bool:
    """Whether a refusal can be derived anywhere in `text`."""
    words = ["^"]
    for word in TOKENS.findall(text.lower().replace("’", "'")):
        if word[0].isalnum():
            words.append(word)
        elif words[-1] != "^":
            words.append("^")
    words = [*words, "^"] if words[-1] != "^" else words
    # a comma within a phrase parts nothing: it is tried with and without
    bare = ["^", *(w for w in words if w != "^")]
    first = beginnings("REFUSAL")
    return any(w in first and derived("REFUSAL", own, k) for own in (words, bare) for k, w in enumerate(own))


# ---------------------------------------------------------------------------------------------- copies of the question

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Words that only announce a question.
ANNOUNCING = frozenset("question the is was here asked you i my your answer q a frage die lautet ist la est pregunta es domanda vraag de".split())
LEAST_TILE = 3


def longest_runs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """For each place of `a`, the length of the longest run from there that `b` holds, and its first place in `b`.

    Only places of `b` with the same word are looked at, from the back, so that each run grows from the one behind it.
    """
    places: dict[str, list[int]] = {}
    for j, word in enumerate(b):
        places.setdefault(word, []).append(j)
    behind: dict[int, int] = {}
    runs = [(0, 0)] * len(a)
    for i in range(len(a) - 1, -1, -1):
        behind = {j: behind.get(j + 1, 0) + 1 for j in places.get(a[i], ())}
        if behind:
            runs[i] = max(((k, -j) for j, k in behind.items()))
            runs[i] = (runs[i][0], -runs[i][1])
    return runs


def tiles(a: list[str], b: list[str], least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of `a` by runs of `b`: the longest first, no word of `a` in two tiles, as (place in a, place in b,
    length). `b` may be used again and again, as by an answer that repeats its question."""
    runs = longest_runs(a, b)
    waiting = [(-k, i, j) for i, (k, j) in enumerate(runs) if k >= least]
    heapq.heapify(waiting)
    marked, found = [False] * len(a), []
    while waiting:
        k, i, j = heapq.heappop(waiting)
        free = 0
        while free < -k and not marked[i + free]:
            free += 1
        if free == -k:
            marked[i : i + free] = [True] * free
            found.append((i, j, free))
        elif free >= least:
            heapq.heappush(waiting, (-free, i, j))
    return found


def copies_question(question: str, answer: str) -> bool:
    """Whether all of the answer is taken from the question, announcing words aside, and most of the question is in it."""
    q, a = (WORD.findall(unicodedata.normalize("NFKC", x).casefold()) for x in (question, answer))
    if not q or not a or not ANNOUNCING.union(q).issuperset(a):
        return False
    laid = tiles(a, q + q, min(LEAST_TILE, len(q)))  # twice, so that a run may go on into the next copy
    covered = {k for i, _, n in laid for k in range(i, i + n)}
    asked = {k % len(q) for _, j, n in laid for k in range(j, j + n)}
    return len(asked) >= 0.75 * len(q) and all(a[k] in ANNOUNCING for k in range(len(a)) if k not in covered)


# ---------------------------------------------------------------------------------------------- languages

#: Frequent words by language; a word of several counts for each in part.
LANGUAGE_WORDS = {
    "en": "the of and to in is was were for on by with at from as that this which what how who when where why are has have had not it its will would because between after before during more than or be been all do does did year years million according",
    "fr": "le la les de des du un une et en est était dans que qui par pour sur au aux avec ce cette ces se sa son il elle ne pas plus été ont à combien quelle quel quels pourquoi raison selon montant atteint hausse baisse exercice année millions il s l d qu lors",
    "de": "der die das und in den von zu mit dem des ist im nicht ein eine einer eines auf für als auch wie wodurch warum wer wann war waren es vor allem wegen bei lag aus am wird wurde durch sich beruht beträgt jahr millionen höher",
    "es": "el los las la y en de del con su al que es lo por para como más fue sobre o a un una según segun qué cuánto cuál quién debido importe total ejercicio millones año ascendió explica",
    "it": "il lo la gli le e di del della dei delle nel nella in un una che è per con da al alla era sono quanto quale quali perché rispetto anno importo milioni ammonta l all",
    "pt": "o a os as e de do da dos das em no na um uma que é para com por não foi ao à segundo quanto qual ano milhões montante",
    "nl": "de het een en van in was te ten op voor met dat die is niet aan bij door naar uit om er waren hoeveel welke waarom jaar miljoen ongeveer opzichte bedroeg bedrag vorige",
}
_SHARED: dict[str, dict[str, float]] = {}
for _language, _words in LANGUAGE_WORDS.items():
    for _word in set(_words.split()):
        _SHARED.setdefault(_word, {})[_language] = 0.0
for _word, _by in _SHARED.items():
    for _language in _by:
        _by[_language] = 1 / len(_by)


@lru_cache(maxsize=50_000)
def language(text: str) -> str | None:
    """The language of `text` as far as its script and frequent words show it; None where they don't."""
    letters = [c for c in text if c.isalpha()]
    other = [c for c in letters if ord(c) > 0x24F]
    if len(other) > len(letters) / 2:
        names = [unicodedata.name(c, "?").split(" ")[0] for c in other]
        return max(set(names), key=names.count)
    scores: dict[str, float] = {}
    words = WORD.findall(text.lower())
    for word in words:
        for of, weight in _SHARED.get(word, {}).items():
            scores[of] = scores.get(of, 0.0) + weight
    ranked = sorted(scores.items(), key=lambda x: -x[1])
    if not ranked or ranked[0][1] < 1.2 or len(ranked) > 1 and ranked[0][1] < 1.3 * ranked[1][1]:
        return None
    return ranked[0][0]


# ---------------------------------------------------------------------------------------------- one pair

ENDED = regex.compile(r"[.!?。！？؟][\"'”’»)\]*_]*\Z")
LAST = regex.compile(r"(?:\A|\s)[(\[\"“«']*(\p{L}[\p{L}\p{M}'’\-‐]*)\Z")


def answer_text(answer: str | None, raw_output: str | None) -> tuple[str, bool]:
    """The answer's text, from raw_output where answer is null, and whether raw_output ends inside it."""
    texts, inside = json_texts(raw_output)
    if answer is None:
        return " ".join(texts), inside
    given = " ".join(texts).rstrip(" …")
    return answer, inside and bool(given) and answer.rstrip(" …").endswith(given[-20:])


def defect_of(question: str | None, answer: str | None, raw_output: str | None, expected: str | None) -> tuple[str | None, str, str | None]:
    """(defect, answer text, word that the answer ends in): the word where only the corpus can tell whether it is cut."""
    text, inside = answer_text(answer, raw_output)
    bare = "".join(c for c in text if c.isalnum() or unicodedata.category(c) in ("Sc", "So", "Sm", "Lo"))
    if not bare:
        return "empty", text, None
    if is_refusal(text):
        return ("refusal" if expected == "answered" else None), text, None
    if question and copies_question(question, text):
        return "copied_question", text, None
    stripped = text.rstrip()
    if inside or open_at_end(stripped):
        return "truncated", text, None
    spoken, asked = language(text), language(question or "")
    if spoken and asked and spoken != asked:
        return "other_language", text, None
    last = None if ENDED.search(stripped) or " " not in stripped else LAST.search(stripped)
    if last and regex.search(r"(?:\A|\s)\W*\p{Lu}\S*\s\Z", stripped[: last.start() + 1]):
        last = None  # part of a name
    if last and spoken == "en" and last.group(1) in NEVER_LAST:
        return "truncated", text, None
    return None, text, last.group(1) if last and last.group(1)[0].islower() else None


@F.pandas_udf(T.StructType([T.StructField("defect", T.StringType()), T.StructField("text", T.StringType()), T.StructField("last_word", T.StringType())]))
def _defects(question: pd.Series, answer: pd.Series, raw_output: pd.Series, expected: pd.Series) -> pd.DataFrame:
    rows = [defect_of(*(None if x is None or x is pd.NA else x for x in row)) for row in zip(question, answer, raw_output, expected, strict=True)]
    return pd.DataFrame(rows, columns=["defect", "text", "last_word"])


#: A word does not end a sentence if so many other uses go on after it and at most this share of them ends a phrase.
CONTINUED, MOST_ENDINGS = 5, 0.02
#: A beginning of a word is a cut word if it ends answers at most in this ratio to the uses of the word.
MOST_LAST = 0.5


def word_uses(texts: DataFrame) -> DataFrame:
    """(word, n_mid, n_end, n_last): how often each word of the texts' `text` goes on to another, how often punctuation
    follows it, and how often a text ends in it without any. Capitals count: names end answers that words do not."""
    tokens = texts.select(F.split(F.trim("text"), r"(?U)\s+").alias("t")).select(F.posexplode("t").alias("k", "token"), F.size("t").alias("n"))
    word = r"^[(\[\"“«']*(\p{L}[\p{L}\p{M}'’\-‐]*)(\W*)$"
    used = tokens.select(F.regexp_extract("token", word, 1).alias("word"), F.regexp_extract("token", word, 2).rlike(r"[.,;:!?)]").alias("ends"), (F.col("k") == F.col("n") - 1).alias("last")).where("word <> ''")
    return used.groupBy("word").agg(F.count_if(~F.col("ends") & ~F.col("last")).alias("n_mid"), F.count_if("ends").alias("n_end"), F.count_if(~F.col("ends") & F.col("last")).alias("n_last"))


def defective_pairs(results: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(uid, defect): the defective pairs, once each, with one kind of defect at most.

    Kinds are tried in the order empty, refusal, copied_question, truncated by form, other_language, truncated by words.
    A null question can neither be copied nor differ in language; a null expected_status makes no refusal a defect.
    Whether a last word breaks off is told from its other uses in all answers and in the texts of `reference` (text).
    """
    once = results.select("uid", "question", "answer", "raw_output", "expected_status").dropDuplicates(["uid"])
    # four consumers: it is looked at once
    looked = checkpointed(once.select("uid", _defects("question", "answer", "raw_output", "expected_status").alias("d")).select("uid", "d.*"))
    texts = looked.where("defect IS NULL OR defect = 'truncated'").select("text")
    uses = word_uses(texts if reference is None else texts.unionAll(reference.select("text")))
    known = uses.where("n_mid + n_end > 0 AND length(word) > 1")
    beginnings = known.select((F.col("n_mid") + F.col("n_end")).alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("word") - 2)), lambda k: F.substring(F.col("word"), F.lit(1), k + 1))).alias("start")).groupBy("start").agg(F.max("n").alias("n_whole"))
    endings = looked.where("last_word IS NOT NULL").select("last_word").distinct()
    judged = endings.join(uses, endings["last_word"] == uses["word"], "left").join(beginnings, F.col("last_word") == beginnings["start"], "left")
    goes_on = (F.col("n_mid") >= CONTINUED) & (F.col("n_end") <= MOST_ENDINGS * F.col("n_mid"))
    cut = (F.col("n_mid") + F.col("n_end") == 0) & (F.col("n_last") <= 1 + MOST_LAST * F.col("n_whole"))
    judged = judged.select("last_word", (F.coalesce(goes_on, F.lit(False)) | F.coalesce(cut, F.lit(False))).alias("breaks_off"))
    return looked.join(judged, "last_word", "left").select("uid", F.when(F.col("defect").isNull() & F.col("breaks_off"), "truncated").otherwise(F.col("defect")).alias("defect")).where("defect IS NOT NULL")
