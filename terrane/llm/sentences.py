"""Sentence spans in subtitle texts of many languages and scripts.

What ends in a period is learned without labels, for each language from the whole corpus: how often a word has a period
behind it against how often it hasn't (a log-likelihood ratio tells abbreviations from words that end sentences), whether
what carries the period also stands before ``?``, ``!`` and pauses (then it may end a sentence) or before numbers, which
words follow an ordinal number's period, and which follow quoted speech after a comma. With the abbreviations known, two
more log-likelihood ratios tell the sentence starters (words that follow an end mark more often than they occur
elsewhere) and the collocations (words that follow the period of an abbreviation, initial or number more often than they
occur elsewhere, and are no starters). Each period, mark and pause is then classified by these statistics and by the case
of what follows; texts in one case, or of scripts without case, go by the statistics alone.

The notation is masked place by place before: cue heads, markup, sound descriptions, songs and dialogue dashes. Places
are those of Unicode characters in the text as it is stored.

Chinese, Japanese: a cue ends its sentence. Thai: so does every blank or line break.

Defined results: null and empty texts, and texts without speech, have no sentences; a text without an end mark is one
sentence; texts of any length are read whole, in time linear in it; the language column is a hint only (null, unknown
and wrong values are fine), as is the notation; repeated rows give repeated spans, for one id once; an empty table gives
no rows; extra columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP, TAG, BREAK, DASH = "\x01", "\x02", "\x03", "\x04"
#: Note signs, and quotation marks.
NOTES = "♪♫♬♩"
OPEN = "\"'“„«‘‚「『‹»”"
CLOSE = "\"'”’»」』›“«"
WS = " \t\r\n\xa0\x01\x02"

_HEAD = re.compile(r"(?m)^(?:\ufeff?[ \t]*\d+[ \t]*\r?\n)?\ufeff?[ \t]*\d+:\d\d[^\n>]*->[^\n]*\n?|^\ufeff?WEBVTT[^\n]*\n?(?:(?:Kind|Language|X-TIMESTAMP-MAP|NOTE|STYLE|REGION)\b[^\n]*\n)*|^\ufeff?\{\d+\}\{\d+\}(?:(?<=\{1\}\{1\})\d+\.\d+(?=\r?\n|\Z))?")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|\{(?:\\|[A-Za-z]:)[^{}\n]*\}")
_SOUND = re.compile(r"[\[(（［【*♪♫♬♩](?:(?<=\[)[^\[\]\x01]*\]|(?<=\()[^()\x01]*\)|(?<=（)[^（）\x01]*）|(?<=［)[^［］\x01]*］|(?<=【)[^【】\x01]*】|(?<=\*)[^*\n\x01]+\*|(?<=[♪♫♬♩])(?:[～〜~]+|(?=[ \t\r]*(?:\n|\Z|\x01))|[^\n\x01♪♫♬♩]*[♪♫♬♩]+|[^\x01♪♫♬♩]*[♪♫♬♩]+|[^\n\x01]*))")
_DASH = re.compile(r"(?m)(?:^|(?<=\x01))([ \t\xa0\ufeff\x02]*)([-–—]+)(?=[ \t\xa0\x02]*[^\s\x01\x02\x03\-–—])")
_MARKS = {"": ".!?…", "el": ".!?…;;", "hy": ".!?…։", "ar": ".!?…؟", "hi": ".!?…।॥", "am": ".!?…።፧", "zh": ".!?…。！？", "ja": ".!?…。！？", "th": ".!?…"}
_TERM = {k: re.compile(f"[{re.escape(v)}][{re.escape(v)}]*") for k, v in _MARKS.items()}
_NEXT = re.compile(f"[{WS}]*")
_WORD = re.compile(r"[^\W_]|[�×÷¨¸]")
_START = re.compile("(?:[\"'“„«‘‚「『‹»”¿¡]+[" + WS + "]*)*(?:[^\\W_]|[�×÷¨¸#$€£№@&+*/])")
_CASED = {"en", "es", "de", "fr", "pl", "ru", "el", "hy"}
#: Common function words by which Latin texts are told apart.
_FUNCTION = {
    "en": frozenset("the and with your when where who what that this you them those please because over before us".split()),
    "es": frozenset("la el los del una con pero porque su cuando que y bajo hacia entre".split()),
    "de": frozenset("und die der das dem nicht wir zu weil es eine aber nach über unter".split()),
    "fr": frozenset("le la les une ne mais nous que où sans cette sur dans du toujours".split()),
    "pl": frozenset("nie pod każdy przez jeszcze mój więc kiedy że jest nad do zanim gdy bez".split()),
}
_ALIAS = {"eng": "en", "spa": "es", "rus": "ru", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "pol": "pl", "jpn": "ja", "chi": "zh", "zho": "zh", "tha": "th", "hin": "hi", "ara": "ar", "ell": "el", "gre": "el", "hye": "hy", "arm": "hy", "amh": "am", "jp": "ja", "cn": "zh", "gr": "el"}
_BLOCKS = [(0x370, 0x400, "el"), (0x400, 0x530, "ru"), (0x530, 0x590, "hy"), (0x600, 0x700, "ar"), (0x900, 0x980, "hi"), (0xE00, 0xE80, "th"), (0x1200, 0x1380, "am"), (0x1F00, 0x2000, "el"), (0x3040, 0x3100, "kana"), (0x3400, 0xA000, "han")]


def mask(text: str) -> str:
    """The text with what isn't speech overwritten, place by place."""
    t = _HEAD.sub(lambda m: GAP * len(m[0]), text)
    if "}" in text and "{" in text and re.search(r"(?m)^\ufeff?\{\d+\}\{\d+\}", text):
        t = t.replace("|", "\n")
    if "<" in t or "{" in t:
        t = _TAG.sub(lambda m: TAG * len(m[0]), t)
    t = _SOUND.sub(lambda m: BREAK * len(m[0]), t)
    return _DASH.sub(lambda m: m[1] + DASH * len(m[2]), t)


@lru_cache(maxsize=1 << 16)
def _block(c: str) -> str:
    n = ord(c)
    if n < 0x250:
        return "latin" if c.isalpha() else ""
    return next((name for lo, hi, name in _BLOCKS if lo <= n < hi), "")


def normal_lang(lang: str | None) -> str:
    lang = re.split("[-_]", (lang or "").strip().lower())[0]
    return _ALIAS.get(lang, lang)


def language(text: str, hint: str | None) -> str:
    """The language by the text's script and, among Latin ones, by function words; the hint decides where these don't."""
    seen = Counter()
    for c, n in Counter(text).items():
        seen[_block(c)] += n
    seen.pop("", None)
    hint = normal_lang(hint)
    latin = seen.pop("latin", 0)
    if seen:
        top, n = seen.most_common(1)[0]
        if top in ("kana", "han"):
            n = seen["kana"] + seen["han"]
            top = "ja" if seen["kana"] * 10 > n else "zh"
        if n * 2 > latin:
            return top
    if not latin:
        return hint or "en"
    words = set(text.lower().split())
    score = {k: len(v & words) / len(v) for k, v in _FUNCTION.items()}
    best = max(score, key=score.get)
    if score[best] == 0 or score.get(hint, -1) == score[best]:
        return hint or "en"
    return best


_AFTER_MARK = re.compile("[.?!…][" + WS + "]+([^\\W\\d_])")


def _letter_case(t: str) -> str:
    """'mixed', or 'lower' or 'upper' for texts in one case: by their letters, and by those that follow end marks."""
    seen = Counter(t).items()
    upper, lower = sum(n for c, n in seen if c.isupper()), sum(n for c, n in seen if c.islower())
    if upper > 2 * lower:
        return "upper"
    if upper > 0.12 * lower:
        return "mixed"
    if upper <= 0.008 * lower:
        return "lower"
    first = _AFTER_MARK.findall(t)
    return "lower" if len(first) > 2 and 10 * sum(map(str.islower, first)) > 6 * len(first) else "mixed"


class Model:
    """What was learned of one language: abbreviations by kind, followers of ordinals, verbs after speech, sentence
    starters, and collocations (abbreviation, initial or ``NUMBER``; next word or ``NUMBER``)."""

    def __init__(self):
        self.title: set[str] = set()
        self.number: set[str] = set()
        self.last: set[str] = set()
        self.ordinal: set[str] = set()
        self.verb: set[str] = set()
        self.starter: set[str] = set()
        self.joined: set[tuple[str, str]] = set()


_TOKEN = re.compile(r"^[^\w�]*(.*?)([.!?…,;:\"'”’»“«)\]।።؟،։]*)$", re.S)
_ORDINAL = re.compile(r"(?<![\w.,:-])\d{1,2}\.[ \r\n]{1,2}([^\W\d_]+)")
_BEFORE_NUMBER = re.compile(r"([^\s.,!?]+)\.[ \r\n]{1,2}\d")
_SAID = re.compile("[,،፣،](?:[\"'”’»“」』])[ \\r\\n]{1,2}([^\\W\\d_][^\\s.,!?\"'”»]*)")


#: Stands for all numbers; what a word after a mark may be; and the marks counted before such words.
NUMBER = "#"
_FOLLOWER = re.compile(r"[\"'“„«‘「『¿¡]*([^\s\x01-\x04.,!?\"'”»:;…]*)(:?)")
_ENDING = frozenset(".?!।॥።፧؟։")


def _form(w: str) -> str:
    """A word as it is counted after a mark, or nothing if it is none."""
    return NUMBER if w[:1].isdigit() else w.rstrip("।॥።፧؟։،፣、)]") if w[:1].isalpha() else ""


class Evidence:
    """Counts of one batch of texts: (language, what, word, next word or None)."""

    def __init__(self):
        self.raw: dict[str, Counter] = {}
        self.pairs: dict[str, Counter] = {}
        self.into: Counter = Counter()

    def add(self, text: str, hint: str | None) -> None:
        t = _SOUND.sub("\n", _HEAD.sub(GAP, text)).replace(GAP, "\n")  # no description runs over a cue
        if "<" in t:
            t = _TAG.sub("", t)
        lang = language(t, hint)
        if lang in ("zh", "ja", "th"):
            return
        if lang not in self.raw:
            self.raw[lang], self.pairs[lang] = Counter(), Counter()
        tokens = t.split()
        self.raw[lang].update(tokens)
        self.pairs[lang].update(x for x in zip(tokens, tokens[1:]) if x[0][-1] in _ENDING)
        for what, found in (("ordinal", _ORDINAL), ("number", _BEFORE_NUMBER), ("said", _SAID)):
            for w in found.findall(t):
                self.into[lang, what, w.lower().lstrip("\"'“«„(¿¡-"), None] += 1

    def counts(self) -> Counter:
        into = self.into
        for lang, raws in self.raw.items():
            for raw, n in raws.items():
                if form := _form(_FOLLOWER.match(raw)[1].lower()):
                    into[lang, "any", form, None] += n
                word, tail = _TOKEN.match(raw).groups()
                word = word.lower()
                if not word or word[0].isdigit():
                    continue
                into[lang, "all", word, None] += n
                if tail[:1] == "." and tail[1:2] not in (".", "?", "!"):
                    into[lang, "dot", word, None] += n
                elif tail[:1] and tail[0] in "!?….":
                    into[lang, "mark", word, None] += n
        for lang, pairs in self.pairs.items():
            for (raw, after), n in pairs.items():
                follower, label = _FOLLOWER.match(after).groups()
                form = _form(follower.lower())
                if not form or label:  # a speaker's name begins its sentence, but says nothing of the name elsewhere
                    continue
                if raw[-1] != ".":
                    into[lang, "start", form, None] += n
                elif raw[-2:-1] not in (".", "?", "!", "…"):
                    word = _TOKEN.match(raw)[1].lower()
                    if word.isdigit() and len(word) <= 2:
                        word = NUMBER
                    if word:
                        into[lang, "pair", word, form] += n
                        if follower[0].isupper() and not follower.isupper():
                            into[lang, "capital", word, form] += n
        return into


#: A word of a language's model has been seen so often.
LEAST = 5


def learn(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> dict[str, Model]:
    """Models of every language from all of ``docs``: partial counts, one shuffle of words, and what passes the tests.

    The words that pass come to the driver, and are sent to all tasks; they are a language's, whatever the number of texts.
    """

    def run(batches):
        for b in batches:
            seen = Evidence()
            for text, hint in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    seen.add(text, hint)
            into = seen.counts()
            keys = list(into)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array(list(into.values()), pa.int64())], names=["lang", "what", "word", "next", "n"])

    hint = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    counts = docs.select(F.col(text_col).cast("string").alias("text"), hint.alias("hint")).mapInArrow(run, "lang string, what string, word string, next string, n bigint")
    of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    words = counts.groupBy("lang", "word", "next").agg(*[of(w).alias(w) for w in ("all", "dot", "mark", "ordinal", "number", "said", "any", "start", "pair", "capital")])
    from terrane.session import materialize, release

    words = materialize(words)
    totals = {r["lang"]: (r["dots"], r["n"], r["said"]) for r in words.groupBy("lang").agg(F.sum("dot").alias("dots"), F.sum("all").alias("n"), F.sum("said").alias("said")).collect()}
    telling = (F.col("dot") >= LEAST) & (F.col("dot") * 5 >= F.col("all") * 2) | (F.col("ordinal") >= LEAST) | (F.col("said") >= LEAST)
    rows = words.filter(telling).select("lang", "word", "all", "dot", "mark", "ordinal", "number", "said")

    def passing(batches):
        for b in batches:
            found = [(r["lang"], r["word"], kind) for r in b.to_pylist() for kind in _kinds(r, *totals[r["lang"]])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["lang", "word", "kind"])

    models: dict[str, Model] = {lang: Model() for lang in totals}
    for r in rows.mapInArrow(passing, "lang string, word string, kind string").collect():
        getattr(models[r["lang"]], r["kind"]).add(r["word"])
    known = docs.sparkSession.createDataFrame([(lang, w, w in m.last) for lang, m in models.items() for w in m.title | m.number | m.last], "lang string, word string, last boolean")
    starters, joined = _neighbours(words, known)
    for r in starters.collect():
        models[r["lang"]].starter.add(r["word"])
    for r in joined.collect():
        models[r["lang"]].joined.add((r["word"], r["next"]))
    release(words)
    return models


#: Least log-likelihood ratios of sentence starters and of collocations.
STARTER, COLLOCATION = 30.0, 7.88


def _attracted(k1, n1, k2, n2, least: float):
    """Whether k1 of n1 is a larger share than k2 of n2, by a log-likelihood ratio of ``least`` or more."""
    share = lambda k, n: k / F.greatest(n, F.lit(1))
    part = lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(0.0)
    fit = lambda k, n, p: part(k, p) + part(n - k, 1 - p)
    both = share(k1 + k2, n1 + n2)
    ratio = 2 * (fit(k1, n1, share(k1, n1)) + fit(k2, n2, share(k2, n2)) - fit(k1, n1, both) - fit(k2, n2, both))
    return (share(k1, n1) > share(k2, n2)) & (ratio >= least)


def _neighbours(words: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentence starters (lang, word) and collocations (lang, word, next), from all counts and the ``known`` abbreviations.

    A sentence starts behind a period that belongs to no abbreviation, and with a capital behind one that may end it.
    """
    c = F.col
    pairs = words.filter(c("next").isNotNull()).select("lang", "word", "next", "pair", "capital").join(known, ["lang", "word"], "left")
    held = c("last").isNotNull() | (c("word") == NUMBER)
    more = pairs.groupBy("lang", c("next").alias("word")).agg(F.sum(F.when(~held, c("pair")).when(c("last"), c("capital")).otherwise(0)).alias("more"))
    types = words.filter(c("next").isNull() & (c("any") > 0)).join(more, ["lang", "word"], "left").select("lang", "word", "any", (c("start") + F.coalesce("more", F.lit(0))).alias("begins"))
    sums = types.groupBy("lang").agg(F.sum("any").alias("n"), F.sum("begins").alias("b"))
    starters = types.join(sums, "lang").filter((c("begins") > 0) & (c("word") != NUMBER) & _attracted(c("begins"), c("any"), c("b") - c("begins"), c("n") - c("any"), STARTER)).select("lang", "word")
    first = pairs.filter(held).groupBy("lang", "word").agg(F.sum("pair").alias("first"))
    after = types.select("lang", c("word").alias("next"), "any").join(sums.select("lang", "n"), "lang")
    found = pairs.filter(held & (c("pair") > 1)).join(first, ["lang", "word"]).join(after, ["lang", "next"])
    found = found.filter(_attracted(c("pair"), c("first"), c("any") - c("pair"), c("n") - c("first"), COLLOCATION))
    return starters, found.join(starters.select("lang", c("word").alias("next")), ["lang", "next"], "left_anti").select("lang", "word", "next")


def _kinds(r: dict, dots: int, total: int, said: int) -> list[str]:
    """The sets of its language's model that a word is in, by its counts and the language's totals."""
    out = []
    if r["dot"] >= LEAST and _abbreviation(r["word"], r["dot"], max(r["all"], r["dot"]), dots, total):
        out.append("last" if r["mark"] * 20 >= r["dot"] + r["mark"] else "number" if r["number"] * 2 >= r["dot"] else "title")
    if r["ordinal"] >= LEAST and r["ordinal"] * 2 >= r["all"]:
        out.append("ordinal")
    if r["said"] >= LEAST and r["said"] * 50 >= said:
        out.append("verb")
    return out


def _abbreviation(w: str, k: int, n: int, dots: int, total: int) -> bool:
    """Whether a period belongs to ``w``: k of its n uses have one, of all words dots in total."""
    parts = w.split(".")
    if len(parts) > 1 and max(map(len, parts)) > 2 or not any(c.isalpha() for c in w) or any(c.isdigit() for c in w):
        return False
    if len(w) == 1:
        return k * 5 >= n * 2
    p = min(max(dots / max(total, 1), 1e-9), 0.9)
    fit = lambda q: k * math.log(q) + (n - k) * math.log(1 - q)
    return 2 * (fit(0.99) - fit(p)) >= 7.88


_EMPTY = Model()


def _pair(t: str, i: int, lo: int) -> bool:
    """Whether the period at ``i`` ends one of two or more initials."""
    before, after = t[max(lo, i - 4) : i], t[i + 1 : i + 4]
    two = len(before) >= 4 and before[-1].isalpha() and before[-2] in " \n\xa0" and before[-3] == "." and before[-4].isalpha() and (i - 5 < lo or not t[i - 5].isalnum())
    return two or (len(after) == 3 and after[0] in " \n\xa0" and after[1].isalpha() and after[2] == ".")


def spans(text: str | None, hint: str | None, models: dict[str, Model]) -> list[tuple[int, int]]:
    """(start, end) of each sentence of one text."""
    if not text:
        return []
    t = mask(text)
    lang = language(t, hint)
    model = models.get(lang, _EMPTY)
    letter = _letter_case(t) if lang in _CASED or lang not in _MARKS else "none"
    cues = lang in ("zh", "ja", "th")
    out: list[tuple[int, int]] = []
    for chunk in re.finditer("[^\x01\x03\x04]+" if cues else "[^\x03\x04]+", t):
        lo, hi = chunk.span()
        if lang == "th":
            for line in re.finditer(r"[^\n]+(?:\n(?![^\n]*[฀-๿])[^\n]+)*", t[lo:hi]):
                if any("฀" <= c < "຀" for c in line[0]):
                    for piece in re.finditer(r"[^\s\x02]+", line[0]):
                        _close(t, lo + line.start() + piece.start(), lo + line.start() + piece.end(), out)
                else:
                    _split(t, lo + line.start(), lo + line.end(), "", model, "mixed", out)
            continue
        _split(t, lo, hi, lang, model, letter, out)
    return out


def _close(t: str, lo: int, hi: int, out: list[tuple[int, int]]) -> None:
    """The sentence in ``t[lo:hi]``, if it has a word."""
    m = _START.search(t, lo, hi)
    if not m or not _WORD.search(t, m.start(), hi):
        return
    while t[hi - 1] in WS:
        hi -= 1
    out.append((m.start(), hi))


def _split(t: str, lo: int, hi: int, lang: str, model: Model, letter: str, out: list[tuple[int, int]]) -> None:
    term = _TERM.get(lang, _TERM[""])
    start = lo
    cased = letter == "mixed"
    for m in term.finditer(t, lo, hi):
        i, e = m.span()
        if i < start:
            continue
        c = t[e] if e < hi else ""
        mark = m[0]
        if c.isalnum() and mark == ".":
            # inside a number, an address or an abbreviation; a lost blank only before a capital after a small letter
            if not (cased and c.isupper() and i > start + 1 and t[i - 1].islower() and t[i - 2].islower() and e + 1 < hi and t[e + 1].islower()):
                continue
        # closing quotes
        j = e
        while j < hi:
            c = t[j]
            if c in "\"'":
                # before a word it may open the next sentence: it closes what is open since this one's start
                if j + 1 < hi and t[j + 1].isalnum() and (t.count(c, start, i) - _apostrophes(t, start, i, c)) % 2 == 0:
                    break
            elif c in " \xa0\x02":
                k = j
                while k < hi and t[k] in " \xa0\x02":
                    k += 1
                if k < hi and (t[k] == "»" and t.count("«", start, i) > t.count("»", start, i) or t[j] == TAG and t[k] in "”」』’" or t[k] == '"' and (k + 1 == hi or t[k + 1] in WS) and t.count('"', start, i) % 2):
                    j = k
                    continue
                break
            elif c == "“":
                if t.count("„", start, i) <= t.count("“", start, i):
                    break
            elif c == "«":
                if lang != "de" or j + 1 < hi and t[j + 1].isalnum() and t.count("»", start, i) <= t.count("«", start, i):
                    break
            elif c == "»":
                if lang == "de" and t.count("«", start, i) <= t.count("»", start, i):
                    break
            elif c not in "”’」』›":
                break
            j += 1
        quoted = j > e
        k = _NEXT.match(t, j, hi).end()
        nxt = t[k] if k < hi else ""
        if nxt and not _ends(t, start, i, e, j, k, hi, nxt, mark, quoted, lang, model, letter, cased):
            continue
        _close(t, start, j, out)
        start = j
    if start < hi:
        _close(t, start, hi, out)


def _apostrophes(t: str, lo: int, hi: int, c: str) -> int:
    if c != "'":
        return 0
    return len(re.findall(r"(?<=\w)'(?=\w)", t[lo:hi]))


def _next_word(t: str, k: int, hi: int) -> str:
    return _FOLLOWER.match(t, k, hi)[1].lower()


def _ends(t, start, i, e, j, k, hi, nxt, mark, quoted, lang, model, letter, cased) -> bool:
    """Whether the mark ``t[i:e]``, with its closing quotes to ``j``, ends a sentence before the character at ``k``."""
    if nxt in ",،፣、，:;)" and k == j:
        return False
    if lang in ("zh", "ja"):
        # said by someone, if the quotation particle or a comma follows directly
        return not (quoted and k == j and nxt in "と，、,。") and not (mark == "." and nxt.isalnum() and k == j)
    if quoted:
        if cased and nxt.isalpha():
            return not nxt.islower()
        if not cased and _next_word(t, k, hi) in model.verb:
            return False
        return True
    if mark == ".":
        w = i
        while w > start and t[w - 1] not in " \t\r\n\xa0\x01\x02\"“„«(¿¡":
            w -= 1
        word = t[w:i].lower().lstrip("'-–—")
        if cased and nxt.islower():
            return False
        follower = _next_word(t, k, hi)
        count = word.isdigit() and len(word) <= 2
        if (NUMBER if count else word, _form(follower)) in model.joined and not (cased and word in model.last):
            return False
        if nxt.isdigit():
            return word not in model.number and word not in model.title
        if count:
            return follower not in model.ordinal
        if word in model.last:
            return True
        if len(word) == 1 and _pair(t, i, start):
            return False
        if len(word) == 1 and cased and t[i - 1].isupper():
            return False
        return word not in model.title or len(word) > 1 and _form(follower) in model.starter
    if mark in ("...", "…", "..", "....", "……") and cased and nxt.isalpha():
        return not nxt.islower()
    return True


def sentences(docs: DataFrame, models: dict[str, Model], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(``id_col``, sent_start int, sent_end int): one row for each sentence. A narrow pass, without a shuffle."""

    def run(batches):
        for b in batches:
            ids, rows, starts, ends = b.column(0), [], [], []
            for at, (text, hint) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                found = spans(text, hint, models)
                rows += [at] * len(found)
                starts += [x[0] for x in found]
                ends += [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "sent_start", "sent_end"])

    kind = dict(docs.dtypes)[id_col]
    hint = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), hint.alias("hint")).mapInArrow(run, f"`{id_col}` {kind}, sent_start int, sent_end int")
