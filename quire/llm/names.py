"""Problem 4: variant spellings of the names of people and organisations.

Name parts (family names, first names, firm names) that are one typing error apart come from a trie join: words are
sharded by their halves, one of which an error leaves alone (short ones by what is left without a letter); each shard
becomes a trie, and a Levenshtein automaton of each word walks it. Whole names are then read as parts in any order, completed from the fuller names of the same family
or firm where only one fits, and led along the joined parts to the most frequent spelling of their entity.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.characters import SUSPECT, consistent
from quire.session import checkpointed

# ---------------------------------------------------------------------------------------------- trie join


class Automaton:
    """Levenshtein automaton of `word` for one insertion, deletion, substitution or swap of neighbours.

    A state is a set of (place, errors, swap), swap being true between the two letters of a swap.
    """

    def __init__(self, word: str, errors: int = 1):
        self.word, self.errors = word, errors
        self.steps: dict[tuple[frozenset, str], frozenset] = {}

    def start(self) -> frozenset:
        return self._closed({(0, 0, False)})

    def _closed(self, states: set[tuple[int, int, bool]]) -> frozenset:
        todo = list(states)
        while todo:  # letters of the word that were left out
            i, e, swap = todo.pop()
            if not swap and e < self.errors and i < len(self.word) and (i + 1, e + 1, False) not in states:
                states.add((i + 1, e + 1, False))
                todo.append((i + 1, e + 1, False))
        return frozenset(states)

    def step(self, state: frozenset, letter: str) -> frozenset:
        known = self.steps.get((state, letter))
        if known is None:
            new: set[tuple[int, int, bool]] = set()
            for i, e, swap in state:
                if swap:
                    if self.word[i] == letter:
                        new.add((i + 2, e, False))
                    continue
                if i < len(self.word) and self.word[i] == letter:
                    new.add((i + 1, e, False))
                if e < self.errors:
                    new.add((i, e + 1, False))
                    if i < len(self.word):
                        new.add((i + 1, e + 1, False))
                    if i + 1 < len(self.word) and self.word[i + 1] == letter:
                        new.add((i, e + 1, True))
            known = self.steps[state, letter] = self._closed(new)
        return known

    def accepts(self, state: frozenset) -> bool:
        return any(i == len(self.word) and not swap for i, _, swap in state)

    def walk(self, trie: dict) -> Iterator[str]:
        """The words of `trie` that the automaton accepts."""
        todo = [(trie, self.start(), "")]
        while todo:
            node, state, path = todo.pop()
            for letter, child in node.items():
                if letter == "":
                    if self.accepts(state):
                        yield path
                elif after := self.step(state, letter):
                    todo.append((child, after, path + letter))


def trie_of(words: list[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}
    return root


#: Words of up to so many letters are sharded by what is left without one letter, longer ones by their halves.
SHORT_WORD = 7
#: A shard of more words is split by the rest of its words.
SHARD_WORDS = 20_000


def shards(word: str) -> list[str]:
    """Keys of which two words within one error share at least one.

    For short words these are the word and what is left of it without one letter, so that no more words share one than
    there are letters to put in; for long ones both halves, of four letters at least, and one letter less of each. Words
    of the length between have the keys of both.
    """
    keys = {"=" + word, *("=" + word[:k] + word[k + 1 :] for k in range(len(word)))} if len(word) <= SHORT_WORD + 1 else set()
    if len(word) > SHORT_WORD:
        half = len(word) // 2
        keys |= {side + part for n in (half, half - 1) for side, part in (("<", word[:n]), (">", word[-n:]))}
    return sorted(keys)


def split_shard(word: str, shard: str) -> list[str]:
    """The keys of a word in a shard that is split: the shard's half is the same, so the error is in the rest."""
    if shard[0] == "=":
        return [shard]  # bounded by the alphabet
    n = len(shard) - 1
    return [f"{shard}/{key}" for key in shards(word[n:] if shard[0] == "<" else word[:-n])]


@lru_cache(maxsize=20_000)
def automaton(word: str) -> Automaton:
    return Automaton(word)


def near_words(words: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """(kind, a, b) with a <> b, both ways, of all words of `words` (kind, word) of a kind that are one error apart.

    Words of fewer than four letters are left alone: names so short are one letter apart by nature (Jon, Ron, Don).
    """
    keys, split = F.udf(shards, T.ArrayType(T.StringType())), F.udf(split_shard, T.ArrayType(T.StringType()))
    placed = checkpointed(words.where(F.length("word") >= 4).select("kind", "word", F.explode(keys("word")).alias("shard")))
    large = placed.groupBy("kind", "shard").agg(F.count("*").alias("held")).where((F.col("held") > most) & ~F.col("shard").startswith("="))
    if not large.isEmpty():
        parted = placed.join(large, ["kind", "shard"]).select("kind", "word", F.explode(split("word", "shard")).alias("shard"))
        placed = placed.join(large, ["kind", "shard"], "left_anti").select("kind", "word", "shard").unionAll(parted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def pairs(kind: str) -> pa.RecordBatch:
            trie = trie_of(held)
            found = [(kind, a, b) for a in held for b in automaton(a).walk(trie) if a != b]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], names=["kind", "a", "b"])

        for batch in batches:
            for kind, word, shard in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (kind, shard) != current:
                    if len(held) > 1:
                        yield pairs(current[0])
                    current, held = (kind, shard), []
                held.append(word)
        if len(held) > 1:
            yield pairs(current[0])

    sharded = placed.repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    return checkpointed(sharded.mapInArrow(run, "kind string, a string, b string").distinct())


# ---------------------------------------------------------------------------------------------- reading names

#: Titles, legal forms, words for lines of business, and short forms of first names.
TITLES = frozenset("dr mr mrs ms miss prof professor sir dame lord lady mx rev hon ing dipl jr sr ii iii phd md esq".split())
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "co": "co", "company": "co", "corp": "corp", "corporation": "corp", "inc": "inc", "incorporated": "inc",
    "plc": "plc", "public limited company": "plc", "llc": "llc", "llp": "llp", "lp": "lp", "gmbh": "gmbh", "ag": "ag", "sa": "sa", "sarl": "sarl",
    "srl": "srl", "spa": "spa", "bv": "bv", "nv": "nv", "ab": "ab", "as": "as", "oy": "oy", "kg": "kg", "se": "se", "pty ltd": "pty", "pty limited": "pty",
}
BUSINESS = frozenset(
    """
    associates asset bank banking brothers capital chemicals communications construction consulting electric electronics
    energy engineering enterprises entertainment equipment finance financial foods foundation gas global group health
    holdings hospital hotels industries institute insurance international investments laboratories logistics management
    manufacturing maritime markets materials media medical metals mining motors networks oil partners petroleum
    pharmaceuticals power products properties publishing railways research resources retail services shipping software
    solutions steel stores systems technologies telecommunications textiles trading transport trust university utilities
    ventures water works
    """.split()
)
FILLERS = frozenset("the and of & for".split())
SHORT_NAMES = {
    "alexander": "alex al sandy xander", "alexandra": "alex sandra sandy", "andrew": "andy drew", "anthony": "tony", "antonio": "tony toni",
    "augustine": "gus august augie", "barbara": "barb babs", "benjamin": "ben benny benji", "catherine": "cathy kate katie cate", "charles": "charlie chuck chas chaz",
    "christine": "chris christy tina", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "dorothy": "dot dottie dolly dora",
    "edward": "ed eddie ted ned teddy", "ekaterina": "katya katia kate", "eleanor": "ellie nell nora ella", "elizabeth": "liz lizzie beth betty eliza lisa betsy libby", "frances": "fran francie frankie fanny",
    "francisco": "paco pancho fran cisco", "frederick": "fred freddie", "gabriel": "gabe", "giovanni": "gianni vanni", "giuseppe": "beppe peppe pino", "gregory": "greg", "harold": "hal harry", "henrietta": "etta hetty hettie hattie etti",
    "henry": "harry hank hal", "isabella": "bella isa izzy belle", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans jan johann hannes", "john": "jack johnny", "jonathan": "jon jonny johnny nathan",
    "joseph": "joe joey", "katherine": "kate kathy katie kitty kat", "kenneth": "ken kenny", "lawrence": "larry laurie lars", "leonard": "len lenny leo", "margaret": "peggy maggie meg marge margie greta daisy", "matthias": "matt matti hias", "matthew": "matt",
    "michael": "mike mick mickey micky", "nathaniel": "nat nate nathan", "nicholas": "nick nicky", "olivia": "liv livvy olly", "pamela": "pam", "patricia": "pat patty trish tricia patsy", "patrick": "pat paddy", "penelope": "penny pen nell",
    "peter": "pete", "philip": "phil pip", "raymond": "ray", "rebecca": "becky becca", "richard": "dick rick rich richie ricky", "robert": "bob bobby rob robbie bert", "ronald": "ron ronnie", "samuel": "sam sammy", "samantha": "sam", "sebastian": "seb bastian basti",
    "stephen": "steve", "steven": "steve", "susan": "sue susie", "theodore": "ted theo teddy", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim", "ursula": "ulla ursel uschi ursi", "valentina": "val tina", "victoria": "vicky vicki tori vic",
    "vincent": "vince vinny", "vladimir": "vlad vova volodya", "walter": "walt wally", "william": "bill will billy willy liam", "zachary": "zach zack zac",
}
FORMAL = {}
for _formal, _short in SHORT_NAMES.items():
    for _s in _short.split():
        FORMAL.setdefault(_s, []).append(_formal)



@lru_cache(maxsize=200_000)
def folded(text: str) -> str:
    """One character form, lower case, without accents, single spaces."""
    if regex.search(SUSPECT, text):
        text = consistent(text)[0]
    flat = unicodedata.normalize("NFKD", text.casefold())
    return " ".join("".join(c for c in flat if not unicodedata.combining(c)).split())


def _subsequence(short: str, whole: str) -> bool:
    rest = iter(whole)
    return all(c in rest for c in short)


def shortens(token: str, word: str) -> bool:
    """Whether `token` is a beginning of `word`, or its first letter and later ones in order with its last."""
    return 3 <= len(token) < len(word) and (word.startswith(token) or token[0] == word[0] and token[-1] == word[-1] and _subsequence(token, word))


@lru_cache(maxsize=50_000)
def business_words(token: str) -> tuple[str, ...]:
    """The words for lines of business that `token` may abbreviate."""
    return tuple(sorted(w for w in BUSINESS if shortens(token, w))) if token not in BUSINESS else ()


def shortens_line(short: str, line: str) -> bool:
    """Whether the words of `short` are those of `line`, in any order, some of them abbreviated."""
    left = line.split()
    words = sorted(short.split(), key=lambda w: (w not in left, -len(w)))
    if len(words) != len(left):
        return False
    for word in words:
        match = word if word in left else next((w for w in left if shortens(word, w)), None)
        if match is None:
            return False
        left.remove(match)
    return True


def read_organisation(name: str) -> tuple[str, str, str, str]:
    """(firm, line of business, legal form, "~" if the line is abbreviated) of a folded name; what is not given is empty."""
    tokens = [t for t in regex.split(r"[\s,/\-‐–.()\"'’]+", name.replace("&", " and ")) if t and t not in FILLERS]
    legal = ""
    for size in (3, 2, 1):
        tail = " ".join(tokens[-size:])
        if len(tokens) > size and tail in LEGAL:
            legal, tokens = LEGAL[tail], tokens[:-size]
            break
    firm = [t for t in tokens if t not in BUSINESS]
    if len(firm) > 1:  # an abbreviation counts as one only beside a word that can be the firm's name
        whole = [t for t in firm if not business_words(t)]
        firm = whole or [max(firm, key=len)]
    line = sorted(t for t in tokens if t not in firm)
    if not firm:
        firm, line = tokens, []
    return " ".join(firm), " ".join(line), legal, "~" if any(t not in BUSINESS for t in line) else ""


def read_person(name: str) -> list[str]:
    """[family, first] if a comma tells them apart, else the name's outer parts in order; middle names are left out.

    A single part comes alone. Initials and abbreviations keep their full stop.
    """
    before, comma, after = name.partition(",")
    own = [t for t in regex.split(r"[\s()\"]+", before) if t and t.strip(".") not in TITLES]
    given = [t for t in regex.split(r"[\s()\",]+", after) if t and t.strip(".") not in TITLES]
    if comma and own and given:
        return [" ".join(own), given[0], ","]
    parts = own + given
    split = [p for t in parts for p in (regex.findall(r"[^.]\.", t) if regex.fullmatch(r"(?:\p{L}\.){2,}", t) else [t])]
    return [split[0], split[-1]] if len(split) > 1 else split


READ = T.StructType([T.StructField(n, T.StringType()) for n in ("firm", "line", "legal", "short", "p", "q", "comma")])


@F.pandas_udf(READ)
def _read(label: pd.Series, name: pd.Series) -> pd.DataFrame:
    rows = []
    for kind, text in zip(label, name, strict=True):
        flat = folded(text)
        if kind == "ORGANIZATION":
            rows.append((*read_organisation(flat), None, None, None))
        else:
            parts = read_person(flat)
            rows.append((None, None, None, None, parts[0] if parts else "", parts[1] if len(parts) > 1 else "", "," if len(parts) > 2 else ""))
    return pd.DataFrame(rows, columns=READ.fieldNames())


# ---------------------------------------------------------------------------------------------- linking


def _only(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys + name: the value where all rows of the keys have the same one."""
    return df.groupBy(*keys).agg(F.min(value).alias(name), F.max(value).alias("_most")).where(F.col(name) == F.col("_most")).drop("_most")


def _led(nodes: DataFrame, edges: DataFrame, key: list[str], rounds: int = 3) -> DataFrame:
    """key + root: each node led along its edge to the heaviest neighbour above it and on to the end.

    Whether all are there is looked at after every `rounds` doublings.

    `edges` has key, to (a struct of key) and to_weight, each to a neighbour that is heavier (by weight, then by key).
    """
    best = edges.groupBy(*key).agg(F.max_by("to", F.struct("to_weight", "to")).alias("to"))
    at = checkpointed(nodes.join(best, key, "left").select(F.struct(*key).alias("node"), F.coalesce("to", F.struct(*key)).alias("root")))
    above = lambda at: at.select(F.col("node").alias("root"), F.col("root").alias("above"))
    while True:
        for _ in range(rounds):
            at = at.join(above(at), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        at = checkpointed(at)
        if at.join(above(at), "root").where(F.col("above") != F.col("root")).isEmpty():
            return at.select(*[F.col(f"node.{k}").alias(k) for k in key], "root")


def _heavier(a: str, b: str, key: list[str]) -> F.Column:
    """Whether node b is above node a: by weight, then by key, so that no two are above each other."""
    this, that = F.struct(*[F.col(f"{a}.{k}") for k in key]), F.struct(*[F.col(f"{b}.{k}") for k in key])
    return (F.col(f"{b}.weight") > F.col(f"{a}.weight")) | ((F.col(f"{b}.weight") == F.col(f"{a}.weight")) & (that < this))


def link_organisations(names: DataFrame) -> DataFrame:
    """(name, entity) of `names` (name, n, firm, line, legal, short): entity tells names of different organisations apart."""
    lines = names.where("line <> '' AND short = ''").select("firm", "line", "legal").distinct()
    # an abbreviated line is the firm's only line that it can stand for
    fits_line = F.udf(shortens_line, T.BooleanType())
    meant = names.where("short <> ''").select("firm", F.col("line").alias("shortened")).distinct().join(lines.select("firm", "line").distinct(), "firm").where(fits_line("shortened", "line"))
    meant = checkpointed(_only(meant, ["firm", "shortened"], "line", "meant")).withColumnRenamed("shortened", "line")
    names = checkpointed(names.join(meant, ["firm", "line"], "left").select("name", "n", "firm", F.coalesce("meant", "line").alias("line"), "legal"))
    lines = names.where("line <> ''").select("firm", "line", "legal").distinct()
    # a part of a line, and then none at all, belongs to the firm's only line that fits
    words = lines.select("firm", "line", F.split("line", " ").alias("w")).where(F.size("w") > 1)
    parts = _only(words.select("firm", "line", F.explode(F.transform("w", lambda x: F.array_join(F.array_remove("w", x), " "))).alias("part")).unionAll(words.select("firm", "line", F.explode("w").alias("part"))).distinct(), ["firm", "part"], "line", "by_part").withColumnRenamed("part", "line")
    names = checkpointed(names.join(parts, ["firm", "line"], "left").select("name", "n", "firm", F.coalesce("by_part", "line").alias("line"), "legal"))
    lines = names.where("line <> ''").select("firm", "line", "legal").distinct()
    of_legal = _only(lines.where("legal <> ''"), ["firm", "legal"], "line", "by_legal")
    of_firm = _only(lines, ["firm"], "line", "by_firm")
    full = names.join(of_legal, ["firm", "legal"], "left").join(of_firm, "firm", "left")
    # with several lines, the one that also fits the legal form
    full = checkpointed(full.select("name", "n", "firm", "legal", F.when(F.col("line") == "", F.coalesce(F.when(F.col("legal") != "", F.col("by_legal")), "by_firm", F.lit(""))).otherwise(F.col("line")).alias("line")))
    legals = _only(full.where("legal <> ''"), ["firm", "line"], "legal", "by_line")
    full = checkpointed(full.join(legals, ["firm", "line"], "left").select("name", "n", "firm", "line", F.when(F.col("legal") == "", F.coalesce("by_line", F.lit(""))).otherwise(F.col("legal")).alias("legal")))
    key = ["firm", "line", "legal"]
    nodes = checkpointed(full.groupBy(*key).agg(F.sum("n").alias("weight")))
    near = near_words(nodes.select(F.lit("firm").alias("kind"), F.col("firm").alias("word")).distinct())
    a, b = nodes.alias("a"), nodes.alias("b")
    met = a.join(near, F.col("a.firm") == near["a"]).join(b, (F.col("b.firm") == near["b"]) & (F.col("a.line") == F.col("b.line")))
    fits = (F.col("a.legal") == F.col("b.legal")) | (F.col("a.legal") == "") | (F.col("b.legal") == "")
    edges = met.where(fits & _heavier("a", "b", key)).select(*[F.col(f"a.{k}").alias(k) for k in key], F.struct(*[F.col(f"b.{k}").alias(k) for k in key]).alias("to"), F.col("b.weight").alias("to_weight"))
    return full.join(_led(nodes, edges, key), key).select("name", F.concat_ws("|", "root.firm", "root.line", "root.legal").alias("entity"))


def link_people(names: DataFrame) -> DataFrame:
    """(name, entity) of `names` (name, n, p, q, comma)."""
    two = names.where("q <> ''")
    # which of two parts is the family name: by where names that a comma or a majority decides have it
    ends = two.where("comma = ''").select(F.col("p").alias("part"), "n", F.lit(1).alias("first")).unionAll(two.where("comma = ''").select(F.col("q").alias("part"), "n", F.lit(0).alias("first"))).unionAll(two.where("comma <> ''").select(F.col("p").alias("part"), "n", F.lit(0).alias("first"))).unionAll(two.where("comma <> ''").select(F.col("q").alias("part"), "n", F.lit(1).alias("first")))
    firsts = ends.groupBy("part").agg((F.sum(F.col("n") * F.col("first")) / F.sum("n")).alias("share"))
    given_p = firsts.select(F.col("part").alias("p"), F.col("share").alias("share_p"))
    given_q = firsts.select(F.col("part").alias("q"), F.col("share").alias("share_q"))
    # initials and abbreviations are never family names
    short_p, short_q = F.col("p").rlike(r"\.$") | (F.length("p") == 1), F.col("q").rlike(r"\.$") | (F.length("q") == 1)
    turned = (F.col("comma") != "") | (short_q & ~short_p) | (~short_p & ~short_q & (F.col("share_q") > F.col("share_p")) & (F.col("share_q") > 0.5))
    read = two.join(given_p, "p").join(given_q, "q").select("name", "n", F.when(turned, F.col("p")).otherwise(F.col("q")).alias("family"), F.when(turned, F.col("q")).otherwise(F.col("p")).alias("given"))
    stem = F.regexp_replace("given", r"\.$", "")
    read = checkpointed(read.select("name", "n", "family", stem.alias("given"), ((F.length(stem) == 1) | F.col("given").rlike(r"\.$")).alias("short")))
    key = ["family", "given"]
    nodes = checkpointed(read.where(~F.col("short")).groupBy(*key).agg(F.sum("n").alias("weight")))
    words = nodes.select(F.lit("family").alias("kind"), F.col("family").alias("word")).unionAll(nodes.select(F.lit("given"), F.col("given"))).distinct()
    near = near_words(words)
    near_family, near_given = (near.where(F.col("kind") == kind).select(F.col("a").alias("near_a"), F.col("b").alias("near_b")) for kind in ("family", "given"))
    a, b = nodes.alias("a"), nodes.alias("b")
    out = [*[F.col(f"a.{k}").alias(k) for k in key], F.struct(*[F.col(f"b.{k}").alias(k) for k in key]).alias("to"), F.col("b.weight").alias("to_weight")]
    above = _heavier("a", "b", key)
    by_family = a.join(near_family, F.col("a.family") == F.col("near_a")).join(b, (F.col("b.family") == F.col("near_b")) & (F.col("a.given") == F.col("b.given"))).where(above).select(*out)
    by_given = a.join(near_given, F.col("a.given") == F.col("near_a")).join(b, (F.col("b.given") == F.col("near_b")) & (F.col("a.family") == F.col("b.family"))).where(above).select(*out)
    nodes_root = _led(nodes, by_family.unionAll(by_given), key)
    # short forms, initials and abbreviations belong to the family's only first name that fits, typing errors aside
    roots = checkpointed(nodes_root.select("root.family", "root.given").distinct())
    is_short = F.udf(lambda g: FORMAL.get(g, []), T.ArrayType(T.StringType()))
    formal = nodes.select(*key, F.explode(is_short("given")).alias("formal")).join(roots.select("family", F.col("given").alias("formal")), ["family", "formal"])
    formal = checkpointed(_only(formal, key, "formal", "whole"))
    begun = roots.where(F.length("given") > 1).select("family", F.col("given").alias("whole"), F.explode(F.transform(F.sequence(F.lit(1), F.length("given") - 1), lambda k: F.substring(F.col("given"), F.lit(1), k))).alias("given"))
    # a short form of a longer name is no first name of its own beside it
    own = begun.join(formal.select("family", F.col("given").alias("whole")), ["family", "whole"], "left_anti")
    longer = own.select("family", "whole").join(begun.where(F.length("given") >= 3).select("family", F.col("given").alias("whole")).distinct(), ["family", "whole"], "left_anti").distinct()
    own = own.join(longer, ["family", "whole"], "left_semi")
    begun_only = _only(own, key, "whole", "whole_b")
    placed = read.join(nodes_root, key, "left").join(formal.withColumnRenamed("whole", "whole_f"), key, "left").join(begun_only, key, "left")
    entity_given = F.when(F.col("short"), F.col("whole_b")).otherwise(F.coalesce("whole_f", F.when(F.length("given") >= 3, F.col("whole_b")), "root.given"))
    entity_family = F.when(F.col("short") | F.col("root.family").isNull(), F.col("family")).otherwise(F.col("root.family"))
    return placed.where(entity_given.isNotNull()).select("name", F.concat_ws("|", entity_family, entity_given).alias("entity"))


def linked_names(mentions: DataFrame, label: str = "label", name: str = "normalized_text") -> DataFrame:
    """(label, name, entity) of the distinct names of persons and organisations.

    Null and blank names are left out, other labels too. A name that may belong to several entities, and a person's
    name of one part, gets no entity and so no row.
    """
    names = mentions.where(F.col(label).isin("PERSON", "ORGANIZATION") & (F.trim(F.col(name)) != "")).groupBy(F.col(label).alias("label"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    read = checkpointed(names.select("label", "name", "n", _read("label", "name").alias("r")).select("label", "name", "n", "r.*"))
    organisations = link_organisations(read.where("label = 'ORGANIZATION' AND firm <> ''")).select(F.lit("ORGANIZATION").alias("label"), "name", "entity")
    return organisations.unionAll(link_people(read.where("label = 'PERSON'")).select(F.lit("PERSON").alias("label"), "name", "entity"))


def same_entity_pairs(mentions: DataFrame) -> DataFrame:
    """(label, name_a, name_b): all pairs of different names of one entity, name_a before name_b by code points.

    The pairs are the result asked for; they are made only here, from names that each lead to their entity.
    """
    linked = checkpointed(linked_names(mentions))
    a, b = linked.withColumnRenamed("name", "name_a"), linked.withColumnRenamed("name", "name_b")
    return a.join(b, ["label", "entity"]).where("name_a < name_b").select("label", "name_a", "name_b")
