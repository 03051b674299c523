"""Sentence units of mails in any script, by a hidden-event n-gram language model.

Between words the model inserts hidden boundary events. At each place where a sentence may end (after closing
punctuation that lies in no quotation or bracket, and in scripts without such punctuation at every blank) it weighs
  P(event | word before, whether that word began a sentence)  and  P(word after | word before, event or none),
and forward-backward sums over the events of neighbouring places give the posterior that decides. In a block of any other
script that has no such mark at all an event may stand between any two words; how probable it is follows from
the length of the block and the mean length of sentences, so that only blocks longer than those come to be parted.

The counts come from the whole corpus, without labels: block ends and block starts are sure events, words
inside are sure non-events, and the places between are counted in expectation, over ``ROUNDS`` of EM. An abbreviation
hence shows by never ending a block, a starter by beginning blocks, and a Thai particle by ending them.
Words are classes: short words with a period by themselves, others by shape. The model keeps the ``VOCABULARY`` most
frequent classes of either side and the ``CONTEXTS`` most frequent pairs; all others fall back to shapes, so its size,
and that of its broadcast, doesn't grow with the corpus. A pair that falls back counts for its word before with any word
after; the counts of classes alone are those of all rows.

One unit each without the model: a line with a list marker, a closing formula with its name, a one-line greeting.
Texts that were decoded wrongly are judged as they were meant, at the places where they are.

Defined cases: null, empty and blank texts and mails without an own plain body give no rows. Repeated documents give
repeated rows. An empty corpus gives an empty model and no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.arrow import bounded_batches
from strandlog.llm.mail import mended, own_blocks
from strandlog.sources.shared import cut

#: Sizes of the model, the least count of a class of its own, rounds of EM.
VOCABULARY, CONTEXTS, LEAST, ROUNDS = 8_000, 50_000, 8, 6
#: Prior: sentences inside a block for each block that ends in a given word; weight of word-free counts.
INSIDE, BACKOFF = 2.0, 4.0

#: Marks that end sentences, those of scripts that put no blank after them, closing and opening marks.
TERMINAL = ".!?…؟।॥۔。！？｡"
WIDE = "。！？｡।॥۔"
CLOSERS = "\"'”’“»›」』）)]】》"
OPENERS = "\"'“„‘‚«‹「『（([【《¿¡*_"
#: Scripts whose sentences end at blanks: Thai, Lao, Burmese, Khmer.
UNMARKED = "฀-໿က-႟ក-៿"

TOKEN = re.compile(r"\S+")
INNER = re.compile(f"(?:[{WIDE}…]|[!?](?=[^\\x00-\\x7f]))[{re.escape(TERMINAL)}]*[{re.escape(CLOSERS.replace('“', ''))}]*")
#: A forgotten blank: a mark between two letters, the second a capital (or of a script without case).
JOINED = re.compile(f"(?<=[^\\W\\d_]{{2}})[.!?…؟]+[{re.escape(CLOSERS)}]*(?=[{re.escape(OPENERS)}]*[^\\W\\d_]{{2}})")
WORDLESS = re.compile(f"[{re.escape(CLOSERS)}]+$")
UNMARKED_END = re.compile(f"[{UNMARKED}]$")
JOIN = "~"
#: Class of the words before whose shape isn't among the ``VOCABULARY`` most frequent.
OTHER = "other"
QUOTED = re.compile(
    "„[^“”„]*[“”]|“[^”“]*”|«[^»«]*»|「[^」「]*」|『[^』]*』|（[^）（]*）|\\([^()]*\\)|\"[^\"]*\"|‚[^‘‚]*‘|‹[^›]*›"
)
ITEM = re.compile(r"[ \t]*(?:[-*•‣–·]|(\d{1,3})[.)])[ \t]+\S")
NAME_END = re.compile(f"[{re.escape(TERMINAL)},;:]$")
DIGITS = re.compile(r"\d+")
WIDE_CHARS = re.compile("[\u2e80-\ud7ff]{1,2}")
WIDE_LETTER = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

#: Longer words are classed anew each time, so that what is remembered stays small.
REMEMBERED = 60


def end_mark(token: str) -> str:
    """The marks that end a sentence at the end of a word, with closing marks behind them; empty if there are none."""
    core = token.rstrip(CLOSERS)
    rest = core.rstrip(TERMINAL)
    return token[len(rest) :] if len(rest) < len(core) else ""


@lru_cache(maxsize=200_000)
def before(token: str) -> tuple[str, str]:
    """Classes of a word at which a sentence may end: by itself, and by shape."""
    if UNMARKED_END.search(token):
        return "~" + token[-4:], "~"
    ends = end_mark(token)
    mark = ends or token[-1:]
    core = token[: len(token) - len(mark)].lstrip(OPENERS)
    if mark[0] not in ".…" or not ends:
        return mark, mark
    if core and core[-1] > "⹿":
        return mark, mark
    if "@" in core or "://" in core:
        return "@" + mark, "@" + mark
    shape = DIGITS.sub("#", core.lower())
    if any(c.isdigit() for c in core):
        plain = "#" if shape == "#" else "#.#" if not any(c.isalpha() for c in shape) else "a#"
        return (shape if len(shape) <= 4 else plain) + mark, plain + mark
    size = "1" if len(core) <= 1 else "3" if len(core) <= 3 else "6" if len(core) <= 6 else "9"
    if "." in core:
        size = "i"
    return (shape if len(core) <= 8 else "w" + size) + mark, "w" + size + mark


@lru_cache(maxsize=200_000)
def after(token: str, follow: str, wide: bool) -> tuple[str, str]:
    """(case, class) of a word at which a sentence may begin; for numbers with the word that follows.

    Other words have two classes, parted by JOIN: the word itself, and '_' with the word that follows, which tells names apart.

    ``wide``: in a text of wide characters, where Latin words are names whatever they are, and what is attached to them counts.
    """
    t = token.lstrip(OPENERS)
    quote = '"' if t != token else ""
    if not t:
        return "o", quote + "-"
    c = t[0]
    if c > "⹿" and not ("＀" <= c <= "／"):
        return "o", quote + t[:2]
    if "฀" <= c <= "႟" or "ក" <= c <= "៿":
        return "o", quote + t[:5]
    case = "U" if c.isupper() else "L" if c.islower() else "o"
    if wide and case != "o":
        m = WIDE_CHARS.search(t)
        return "J", quote + "*" + (m[0] if m else "")
    if c.isdigit():
        tail = DIGITS.sub("#", t)[:4]
        w = WORD.match(follow) if tail == "#" else None
        return "o", quote + tail + (" " + w[0].lower()[:10] if w else "")
    if "@" in t or "://" in t:
        return case, quote + "@"
    w = WORD.match(t)
    if not w:
        return case, quote + t[:2]
    word = quote + w[0].lower()[:14] + t[w.end() : w.end() + 1].replace(",", "")
    next_word = WORD.match(follow)
    mark = "," if t.endswith(",") else ""
    return case, word + (JOIN + quote + "_" + mark + next_word[0].lower()[:10] if next_word and not t.endswith((".", "!", "?")) else "")


def class_before(token: str) -> tuple[str, str]:
    return before(token) if len(token) <= REMEMBERED else before.__wrapped__(token)


def class_after(token: str, follow: str, wide: bool) -> tuple[str, str]:
    return after(token, follow, wide) if len(token) + len(follow) <= 2 * REMEMBERED else after.__wrapped__(token, follow, wide)


#: Class of the word before a gap of a block without marks, and the least words of such a block (shorter ones have no room for an event).
GAP, GAP_WORDS = "_", 12


class Place(NamedTuple):
    """Where a sentence may end, the classes around it, and whether its word is the first or directly follows another place."""

    end: int
    exact: str
    shape: str
    case: str
    next: str
    first: bool
    near: bool


def is_wide(text: str) -> bool:
    """Whether a segment is written without blanks: one character in 20 at least is of such a script."""
    return not text.isascii() and 20 * len(WIDE_LETTER.findall(text)) > len(text)


def places(text: str, wide: bool) -> tuple[list[Place], list[tuple[str, str]], tuple[str, str], tuple[str, str]]:
    """Of a segment: its places, the words that surely begin no sentence, the classes of its first word, and of its last.

    The ``shape`` of a gap is the class of the word before it as of a word after a place.
    """
    spans = [m.span() for m in QUOTED.finditer(text)]
    tokens = list(TOKEN.finditer(text))
    raw: list[tuple[int, str, int, int]] = []  # end, word, index of the word, whether inside the word
    ended, small = False, text == text.lower()
    for i, m in enumerate(tokens):
        t = m[0]
        if t.isascii():
            hit = t[-1] in ".!?\"')]" and end_mark(t)
            inner = []
        else:
            inner = [x for x in INNER.finditer(t) if x.end() < len(t)]
            hit = end_mark(t) or UNMARKED_END.search(t)
        if not inner and len(t) > 5 and (x := JOINED.search(t, 2)) and "@" not in t and "://" not in t and (small or not t[x.end() :].lstrip(OPENERS)[0].islower()):
            inner = [x]
        for x in inner:
            raw.append((m.start() + x.end(), t[: x.end()], i, 1))
        if hit:
            raw.append((m.end(), t, i, 0))
            ended = True
        elif ended and WORDLESS.match(t):
            raw.append((m.end(), "." + t, i, 0))
        else:
            ended = False
    out: list[Place] = []
    starts: set[int] = set()
    last = (-1, 0)
    k = 0
    for end, word, i, part in raw:
        while k < len(spans) and spans[k][1] < end:
            k += 1
        if k < len(spans) and spans[k][0] < end - 1 and end < spans[k][1]:
            continue
        if part:
            nxt, follow = tokens[i][0][end - tokens[i].start() :], ""
        elif i + 1 < len(tokens):
            nxt, follow = tokens[i + 1][0], tokens[i + 2][0] if i + 2 < len(tokens) else ""
            starts.add(i + 1)
        else:
            continue
        exact, shape = class_before(word)
        case, cls = class_after(nxt, follow, wide)
        if cls in ("-", '"-') and WORDLESS.match(nxt):
            continue  # the closing mark stands apart and is the place
        out.append(Place(end, exact, shape, case, cls, i == 0 and not part, last == (i - 1, 0)))
        last = (i, part)
    inside = []
    for i in range(1, len(tokens)):
        if i not in starts:
            t = tokens[i][0]
            inside.append((t, tokens[i + 1][0] if t[0].isupper() and i + 1 < len(tokens) else ""))
    if not raw and len(tokens) >= GAP_WORDS:
        for i in range(1, len(tokens) - 2):  # without a mark a sentence has two words at least
            case, cls = class_after(tokens[i + 1][0], tokens[i + 2][0], wide)
            out.append(Place(tokens[i].end(), GAP, "".join(class_after(tokens[i][0], "", wide)), case, cls, False, i > 1))
    if not tokens:
        return out, inside, ("", ""), ("", "")
    return out, inside, class_after(tokens[0][0], tokens[1][0] if len(tokens) > 1 else "", wide), class_before(tokens[-1][0])


def segments(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the parts of a mail: 'unit' is one unit, 'text' is for the model."""
    for nth, block in enumerate(own_blocks(text)):
        lines = [text[a:z] for a, z in block]
        bare = [mended(x.strip())[0] for x in lines]
        if len(bare) == 1 and nth == 0 and len(bare[0]) < 60 and bare[0][-1] in ",،，:：、":
            yield "unit", *block[0]
            continue
        marks = [ITEM.match(x) for x in lines]
        if 2 <= len(bare) <= 3 and not any(marks) and all(len(x) <= 40 for x in bare) and len(bare[-1]) <= 30 and len(bare[-1].split()) <= 4 and not NAME_END.search(bare[-1]):
            yield "unit", block[0][0], block[-1][1]
            continue
        begun, number = None, None
        for i, (a, z) in enumerate(block):
            m = marks[i]
            item = bool(m)
            if m and m[1]:  # numbers in running text may begin a line, too
                n = int(m[1])
                follows = i + 1 < len(block) and marks[i + 1] and marks[i + 1][1] and int(marks[i + 1][1]) == 2
                item = number is not None and n == number + 1 or n == 1 and bool(follows)
                number = n if item else None
            else:
                number = None
            if item:
                if begun is not None:
                    yield "text", begun, a
                    begun = None
                yield "unit", a, z
            elif begun is None:
                begun = a
        if begun is not None:
            yield "text", begun, block[-1][1]


def parsed(text: str, counts: Counter) -> tuple[list[int], list[tuple[bool, list[tuple]]]]:
    """Of a mail the sure ends of units, and per segment whether it has capitals and its places.

    Adds to ``counts`` what the mail tells: s (class at a start), e (class at an end), c (classes around a place), u (class
    inside), U (the same as a word that has yet to be classed), z (class of the last word without its marks).
    """
    sure, open_ = [], []
    for kind, a, z in segments(text):
        sure.append(a + len(text[a:z].rstrip()))
        if kind == "unit":
            continue
        part, ends = mended(text[a:z])
        wide = is_wide(part)
        found, inside, (case, cls), (exact, shape) = places(part, wide)
        counts["s", "", "", case, cls] += 1
        bare = part.rstrip()
        last = bare.rstrip(CLOSERS + TERMINAL).rsplit(None, 1)[-1:]
        if last:
            counts["z", "", "", *class_after(last[0], "", wide)] += 1
        if end_mark(bare) or UNMARKED_END.search(bare[-1:]):
            counts["e", exact, shape, "", ""] += 1
        for p in found if found and found[0].exact != GAP else ():
            counts["c", ("^" if p.first else "") + p.exact, p.shape, p.case, p.next] += 1
        for w, follow in inside:
            if len(w) + len(follow) <= REMEMBERED:
                counts["U", w, "w" if wide else "", follow, ""] += 1
            else:
                counts["u", "", "", *class_after(w, follow, wide)] += 1
        if found:
            cased = part != part.lower()  # careless writers leave whole paragraphs in small letters
            open_.append((cased, [(a + (p.end if ends is None else ends[p.end - 1]), p.exact, p.shape, p.case, p.next, p.first, p.near) for p in found]))
    return sure, open_


ROW = "kind string, exact string, shape string, case string, next string, n long"


def read_corpus(df: DataFrame, doc: str, text: str) -> DataFrame:
    """One pass over the mails, stored: rows with what 'count', combined in each task, and with what 'mail': _doc and its parse."""
    rows = df.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("_text"))
    names = ["kind", "exact", "shape", "case", "next", "n", "_doc", "parse", "what"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        kind = pa.null()

        def put() -> pa.RecordBatch:
            classed: Counter = Counter()
            for key, n in counts.items():
                classed[("u", "", "", *after(key[1], key[3], bool(key[2]))) if key[0] == "U" else key] += n
            counts.clear()
            cols = list(zip(*classed)) or [()] * 5
            arrays = [*(pa.array(c, pa.string()) for c in cols), pa.array(list(classed.values()), pa.int64()), pa.nulls(len(classed), kind), pa.nulls(len(classed), pa.binary())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(["count"] * len(classed), pa.string())], names=names)

        for b in batches:
            kind = b.column(0).type
            at, parses = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    sure, open_ = parsed(t, counts)
                    if sure:
                        at.append(i)
                        parses.append(pickle.dumps((sure, open_), 5))
            void = pa.nulls(len(at), pa.string())
            yield pa.RecordBatch.from_arrays([void] * 5 + [pa.nulls(len(at), pa.int64()), b.column(0).take(pa.array(at, pa.int64())), pa.array(parses, pa.binary()), pa.array(["mail"] * len(at), pa.string())], names=names)
            if len(counts) > 500_000:
                yield put()
        if counts:
            yield put()

    kind = rows.schema["_doc"].dataType.simpleString()
    return cut(rows.filter("_text is not null").mapInArrow(read, f"{ROW}, _doc {kind}, parse binary, what string"), "sentence-parses", ["what"])


def statistics(read: DataFrame) -> DataFrame:
    """Counts over the whole corpus, of a table made by ``read_corpus``."""
    return read.filter("what = 'count'").groupBy("kind", "exact", "shape", "case", "next").agg(F.sum("n").alias("n"))


class Model:
    """Event and word probabilities as dictionaries of bounded size."""

    def __init__(self) -> None:
        self.known_before: set[str] = set()
        self.known_after: set[str] = set()
        self.known_shapes: set[str] | None = None
        self.tells: dict[str, float] = {}
        self.event: dict[str, float] = {}
        self.start: dict[str, float] = {}
        self.inside: dict[str, float] = {}
        self.pair: tuple[dict[tuple[str, str], float], dict[tuple[str, str], float]] = {}, {}
        self.total: tuple[dict[str, float], dict[str, float]] = {}, {}
        self.words = float("inf")  # of a sentence on average
        self.final: dict[str, float] = {}  # how much oftener a word ends a sentence than it stands inside

    def class_before(self, exact: str, shape: str) -> str:
        if exact in self.known_before:
            return exact
        return ("^" if exact[:1] == "^" else "") + (shape if self.known_shapes is None or shape in self.known_shapes else OTHER)

    def class_after(self, case: str, nxt: str) -> str:
        """Of the two classes of a word the one that tells more about starts."""
        word, _, pair = nxt.partition(JOIN)
        if word not in self.known_after:
            bare = word.lstrip('"')
            word = ('"' if bare != word else "") + ("*c" if bare[:1] > "\u2e7f" else "*t" if "\u0e00" <= bare[:1] <= "\u109f" else "*")
        word, pair = case + word, case + pair
        return pair if abs(self.tells.get(pair, 0.0)) > abs(self.tells.get(word, 0.0)) else word

    def word(self, cur: str, nxt: str, event: int) -> float:
        """P(word after | word before, event), backed off to the word after starts or inside sentences."""
        free = (self.start if event else self.inside).get(nxt, 1e-5)
        return (self.pair[event].get((cur, nxt), 0.0) + BACKOFF * free) / (self.total[event].get(cur, 0.0) + BACKOFF)

    def posteriors(self, found: list, cased: bool) -> list[float]:
        """Forward-backward over the events of a segment, given its places as in ``Place``."""
        n = len(found)
        if not n:
            return []
        emit, to = [], []
        gap = min(0.5, max(0.0, (n + 3) / self.words - 1) / n)
        for _, exact, shape, case, following, opens, near in found:
            cur = self.class_before(exact, shape)
            nxt = self.class_after(case if cased else "n", following)
            if exact == GAP:
                end = self.class_after(shape[:1] if cased else "n", shape[1:])
                emit.append((self.inside.get(nxt, 1e-5), self.start.get(nxt, 1e-5) * self.final.get(end, 1.0)))
                to.append((gap, 0.0 if near else gap))
                continue
            emit.append((self.word(cur, nxt, 0), self.word(cur, nxt, 1)))
            plain = self.event.get(cur, self.event.get(shape, 0.5))
            first = self.event.get(self.class_before("^" + exact, shape), plain)
            to.append((first, first) if opens else (plain, first if near else plain))
        fore = []
        a0, a1 = 1.0, 0.0
        for (e0, e1), (p0, p1) in zip(emit, to):
            one = a0 * p0 + a1 * p1
            b0, b1 = (a0 + a1 - one) * e0, one * e1
            s = b0 + b1 or 1.0
            a0, a1 = b0 / s, b1 / s
            fore.append((a0, a1))
        out = [0.0] * n
        b0 = b1 = 1.0
        for i in range(n - 1, -1, -1):
            a0, a1 = fore[i]
            s = a0 * b0 + a1 * b1 or 1.0
            out[i] = a1 * b1 / s
            (e0, e1), (p0, p1) = emit[i], to[i]
            c0 = (1 - p0) * e0 * b0 + p0 * e1 * b1
            c1 = (1 - p1) * e0 * b0 + p1 * e1 * b1
            s = c0 + c1 or 1.0
            b0, b1 = c0 / s, c1 / s
        return out


def fit(stats: DataFrame) -> Model:
    """EM over the counts; what reaches the driver is bounded by VOCABULARY and CONTEXTS, and no count is left out."""
    m = Model()
    word, pair = F.split_part("next", F.lit(JOIN), F.lit(1)), F.split_part("next", F.lit(JOIN), F.lit(2))
    stats = stats.withColumns({"word": word, "pair": pair})

    def top(c: str, least: int = LEAST) -> list[str]:
        per = stats.filter(F.col(c) != "").filter("kind <> 'z'").groupBy(c).agg(F.sum("n").alias("n"))
        return [r[0] for r in per.filter(F.col("n") >= least).orderBy(F.desc("n"), c).limit(VOCABULARY).collect()]

    m.known_before, m.known_after, m.known_shapes = set(top("exact")), set(top("word")), set(top("shape", 1))
    pairs_known = top("pair")
    spark = stats.sparkSession

    def known(values, column: str, flag: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(x,) for x in values], f"{column} string").withColumn(flag, F.lit(True)))

    first = F.when(F.col("exact").startswith("^"), "^").otherwise("")
    quote, script = F.when(F.col("word").startswith('"'), '"').otherwise(""), F.ltrim(F.col("word"), F.lit('"'))
    rest = F.concat(quote, F.when(script.rlike("^[\u2e80-\uffff]"), "*c").when(script.rlike("^[\u0e00-\u109f]"), "*t").otherwise("*"))
    shape = F.when(F.col("ks") | (F.col("shape") == ""), F.col("shape")).otherwise(OTHER)
    mapped = cut(
        stats.join(known(m.known_before, "exact", "kb"), "exact", "left").join(known(m.known_after, "word", "kw"), "word", "left").join(known(pairs_known, "pair", "kp"), "pair", "left").join(known(m.known_shapes, "shape", "ks"), "shape", "left")
        .select("kind", F.when(F.col("kb"), F.col("exact")).otherwise(F.concat(first, shape)).alias("cur"),
                F.when(F.col("word") == "", "").otherwise(F.concat("case", F.when(F.col("kw"), F.col("word")).otherwise(rest))).alias("nxt"),
                F.when(F.col("kp"), F.concat("case", "pair")).otherwise("").alias("pair"), F.concat("case", rest).alias("rest"), "n")
        .groupBy("kind", "cur", "nxt", "pair").agg(F.sum("n").alias("n"), F.min("rest").alias("rest")),
        "sentence-classes",
    )
    # How much a class tells: the log ratio of its share among sure starts to its share elsewhere, for each kind of class.
    classes = mapped.filter("kind not in ('e', 'z')").select("kind", "n", F.explode(F.array_distinct(F.array("nxt", "pair"))).alias("class"), "nxt").filter("class != '' or nxt = ''")
    seen: dict[str, list[float]] = {}
    plain_classes = set()
    for kind, cls, n in classes.groupBy("kind", "class").agg(F.sum("n")).collect():
        plain_classes.add(cls)
        for c in (cls, "n" + cls[1:]):
            one = seen.setdefault(c, [0.0, 0.0, 0.0])
            one["suc".index(kind)] += n
    at_start, elsewhere = (sum(x[0] for x in seen.values()) or 1.0), (sum(x[1] + x[2] for x in seen.values()) or 1.0)
    for c, (s0, u0, c0) in seen.items():
        other = u0 + max(0.0, c0 - INSIDE * s0)
        m.tells[c] = float(np.log((s0 + 0.5) / at_start) - np.log((other + 0.5) / elsewhere))
    strength = spark.createDataFrame([(c, abs(m.tells[c])) for c in plain_classes], "class string, tells double")
    tells = lambda c: F.broadcast(strength.select(F.col("class").alias(c), F.col("tells").alias(f"{c}_tells")))
    chosen = cut(
        mapped.join(tells("nxt"), "nxt", "left").join(tells("pair"), "pair", "left")
        .select("kind", "cur", F.when((F.col("pair") != "") & (F.col("pair_tells") > F.col("nxt_tells")), F.col("pair")).otherwise(F.col("nxt")).alias("nxt"), "rest", "n")
        .groupBy("kind", "cur", "nxt").agg(F.sum("n").alias("n"), F.min("rest").alias("rest")),
        "sentence-pairs",
    )
    starts, inner, ends, finals, contexts = Counter(), Counter(), Counter(), Counter(), Counter()
    for kind, cur, nxt, n in chosen.filter("kind != 'c'").select("kind", "cur", "nxt", "n").collect():
        if kind == "s":
            starts[nxt] += n
        elif kind == "u":
            inner[nxt] += n
        elif kind == "z":
            finals[nxt] += n
        else:
            ends[cur] += n
    around = chosen.filter("kind = 'c'")
    kept = around.select("n", "cur", "nxt").orderBy(F.desc("n"), "cur", "nxt").limit(CONTEXTS).collect()
    for n, cur, nxt in kept:
        contexts[cur, nxt] += n
    if len(kept) == CONTEXTS:
        beyond = F.struct((-F.col("n")).alias("n"), "cur", "nxt") > F.struct(*(F.lit(v).alias(k) for k, v in zip(("n", "cur", "nxt"), (-kept[-1][0], *kept[-1][1:]))))
        for cur, nxt, n in around.filter(beyond).groupBy("cur", "rest").agg(F.sum("n")).collect():
            contexts[cur, nxt] += n
    pairs = [(a, b, n) for (a, b), n in contexts.items()]
    if not pairs:
        return m
    curs, nxts = sorted({c for c, _, _ in pairs} | set(ends)), sorted({x for _, x, _ in pairs} | set(starts) | set(inner))
    ci, ni = {c: i for i, c in enumerate(curs)}, {x: i for i, x in enumerate(nxts)}
    c = np.array([ci[a] for a, _, _ in pairs])
    x = np.array([ni[b] for _, b, _ in pairs])
    n = np.array([k for _, _, k in pairs], dtype=float)
    end = np.array([float(ends[a]) for a in curs])
    s0 = np.array([float(starts[b]) for b in nxts])
    u0 = np.array([float(inner[b]) for b in nxts])
    smooth = lambda v: (v + 0.02) / (v.sum() + 0.02 * len(v))
    total = np.bincount(c, n, len(curs))
    # What occurs more often than sure starts explain occurs inside sentences.
    start, inside = smooth(s0), smooth(u0 + np.maximum(0, np.bincount(x, n, len(nxts)) - INSIDE * s0))
    event = np.clip((end * INSIDE + 0.05) / (total + 0.1), 0.002, 0.98)
    plain = np.array([ci.get(a.lstrip("^"), i) for i, a in enumerate(curs)])  # of a word that begins a sentence, the word anywhere
    event = event[plain]
    pairs_yes, pairs_no = np.zeros(len(n)), np.zeros(len(n))
    yes_total, no_total = np.zeros(len(curs)), np.zeros(len(curs))
    for _ in range(ROUNDS):
        yes = event[c] * (pairs_yes + BACKOFF * start[x]) / (yes_total[c] + BACKOFF)
        no = (1 - event[c]) * (pairs_no + BACKOFF * inside[x]) / (no_total[c] + BACKOFF)
        post = yes / (yes + no)
        pairs_yes, pairs_no = n * post, n * (1 - post)
        yes_total, no_total = np.bincount(c, pairs_yes, len(curs)), np.bincount(c, pairs_no, len(curs))
        start, inside = smooth(s0 + np.bincount(x, pairs_yes, len(nxts))), smooth(u0 + np.bincount(x, pairs_no, len(nxts)))
        event = (yes_total + 0.02) / (total + 0.04)
        event = np.clip((yes_total + 5 * event[plain]) / (total + 5), 0.001, 0.995)
    m.event = dict(zip(curs, event.tolist()))
    m.words = float((s0.sum() + u0.sum() + n.sum()) / (s0.sum() + yes_total.sum()))
    m.total = dict(zip(curs, no_total.tolist())), dict(zip(curs, yes_total.tolist()))
    # Besides the cases of words, the same without them, for paragraphs that have none.
    for into, p in ((m.start, start), (m.inside, inside)):
        for word, v in zip(nxts, p.tolist()):
            into[word] = v
            into["n" + word[1:]] = into.get("n" + word[1:], 0.0) + v
    z0 = smooth(np.array([float(finals[b]) for b in nxts]))
    plain_final: dict[str, float] = {}
    for word, v in zip(nxts, z0.tolist()):
        plain_final[word] = v
        plain_final["n" + word[1:]] = plain_final.get("n" + word[1:], 0.0) + v
    m.final = {c: v / m.inside[c] for c, v in plain_final.items()}
    m.tells = {c: v for c, v in m.tells.items() if c in m.start}
    for into, p in zip(m.pair, (pairs_no, pairs_yes)):
        for (a, b, _), v in zip(pairs, p.tolist()):
            if v > 1e-3:
                into[a, b] = v
                into[a, "n" + b[1:]] = into.get((a, "n" + b[1:]), 0.0) + v
    return m


def ends_of(sure: list[int], open_: list[tuple[bool, list[tuple]]], model: Model) -> list[int]:
    """Places after the last non-blank character of each unit of a parsed mail."""
    out = set(sure)
    for cased, found in open_:
        out.update(p[0] for p, post in zip(found, model.posteriors(found, cased)) if post > 0.5)
    return sorted(out)


def unit_ends(text: str, model: Model) -> list[int]:
    return ends_of(*parsed(text, Counter()), model)


def sentence_units(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, end_pos) for each unit of each mail. Each mail is parsed once; the second pass reads the stored parses."""
    bounded_batches(df.sparkSession)
    read = read_corpus(df, doc, text)
    model = fit(cut(statistics(read), "sentence-counts"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ends = [], []
            for i, raw in enumerate(b.column(1).to_pylist()):
                found = ends_of(*pickle.loads(raw), shared.value)
                at += [i] * len(found)
                ends += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ends, pa.int32())], names=["_doc", "end_pos"])

    mails = read.filter("what = 'mail'").select("_doc", "parse")
    kind = mails.schema["_doc"].dataType.simpleString()
    return mails.mapInArrow(split, f"_doc {kind}, end_pos int").withColumnRenamed("_doc", doc)
