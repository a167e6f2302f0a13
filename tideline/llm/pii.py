"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Fixed patterns give candidate spans.  Labelers vote on each candidate: the
pattern's own check, a gazetteer (top-level domains, countries, reserved networks,
issuer digits, calling codes), context words before and after it, and its digits'
shape.  Candidates are counted over all rows by their votes and features (a
bounded number of combinations, whatever the input), expectation-maximisation
over these counts estimates how reliable each labeler is, and a logistic span
classifier is trained on the resulting soft labels.  Its features go beyond the
votes: what form the span has, how many digits and separators, and which class of
words stands near, also together with the form.  Base spans (those that pass
their check) always stay; the classifier adds spans of kind ``other``: national
phone and identity numbers, bank accounts, written-out addresses, dates of birth.

Null text counts as empty.  Spans are in code points, end exclusive.  Repeated
rows count and are returned once each.  Spans that tie in kind and start cannot
be; an added span that touches a base span is left out.  Texts of any length go
whole: places are running sums in blocks, so their cost grows far less than with
the square of the matches.  Only the keys and the text are read, so other columns
may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

# The base patterns.  Possessive forms and the start conditions
# change no match; they keep long runs of characters linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
FORMS = {
    "national": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "identity": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "account": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "written": r"[A-Za-z0-9._%+-]{1,64} ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]{1,63}){1,4}",
    "date": r"[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}",
}
OTHER = rf"(?<![0-9A-Za-z+])(?:{'|'.join(FORMS.values())})(?![0-9A-Za-z])"
KINDS = ("email", "ip", "card", "phone", "other")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, OTHER)))

# Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "nl", "uk", "us", "eu", "ch", "at", "be", "pt", "mx", "ca", "example")
CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01])|22[4-9]|2[345][0-9])\."
COUNTRIES = r"^(AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR)"
#: Classes of context words, the first that is near counts; the last speaks against.
CUES = {
    "birth": r"(?i)\b(born|birth|birthday|dob|geboren|geburtsdatum|nacimiento|naissance)\b",
    "contact": r"(?i)\b(mail|e-mail|email|contact|call|tel|phone|fax|mobile|correo|reach|address|adresse)\b",
    "money": r"(?i)\b(card|visa|iban|account|konto|bank|ssn|social security)\b",
    "network": r"(?i)\b(ip|server|host|from)\b",
    "neutral": r"(?i)\b(version|page|isbn|issn|chapter|section|table|figure|ref|line|build|serial|total|price)\b",
}
CONTEXT = 40
#: A candidate that is no base span is added from this probability on.
ADDED_FROM = 0.9
LABELERS = ("check", "gazetteer", "context", "shape")

#: Features of a span besides its votes, each a number below: its form (base kinds, then FORMS), digits, separators, nearest cue.
FEATURES = {"form": len(KINDS) - 1 + len(FORMS), "digits": 5, "separators": 4, "cue": len(CUES) + 1}
NUMBERS = (*LABELERS, *FEATURES)
#: Running sums are made in blocks of so many.
RUN = 64

SPAN = "array<struct<start:int,end:int,keep:boolean,ok:boolean," + ",".join(f"{n}:int" for n in NUMBERS) + ">>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(steps: Column, zero: int, join: Callable[[Column, Column], Column]) -> Column:
    """The array's running fold: within blocks of RUN, then over the blocks, so that no long array is copied for each item."""
    none = F.array().cast("array<int>")

    def fold(items: Column, before: bool) -> Column:
        def step(a: Column, x: Column) -> Column:
            now = join(a["now"], x).cast("int")
            return F.struct(now.alias("now"), F.concat(a["all"], F.array(a["now"] if before else now)).alias("all"))

        return F.aggregate(items, F.struct(F.lit(zero).alias("now"), none.alias("all")), step, lambda a: a["all"])

    def whole(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int"))
        inner = F.transform(starts, lambda b: fold(F.slice(s, b * RUN + 1, F.lit(RUN)), False))
        return _let(inner, lambda i: F.flatten(F.zip_with(i, fold(F.transform(i, lambda o: F.element_at(o, -1)), True), lambda o, b: F.transform(o, lambda x: join(b, x)))))

    return _let(steps, lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(none))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _small(part: Column) -> Column:
    """Whether a run of digits is at most 255."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _sign(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _judged(kind: str, m: Column, before: Column, after: Column) -> tuple[Column, Column, dict[str, Column]]:
    """Whether to keep the candidate at all, whether it passes, and the labelers' votes and the features."""
    digits = _digits(m)
    n = F.length(digits)
    form, valid = F.lit(KINDS.index(kind)), None
    around = F.concat(before, F.lit(" . "), after)
    cue = F.lit(0)
    for k, words in reversed(list(enumerate(CUES.values(), 1))):
        cue = F.when(around.rlike(words), k).otherwise(cue)
    near = _sign((cue > 0) & (cue < len(CUES)), cue == len(CUES))
    if kind == "email":
        keep, ok = F.lit(True), F.lit(True)
        known = F.lower(F.regexp_extract(m, r"\.([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS)
    elif kind == "ip":
        keep, ok = F.lit(True), F.forall(F.split(m, r"\."), _small)
        known = ~m.rlike(RESERVED)
    elif kind == "card":
        keep = n.between(13, 19)
        ok = keep & F.call_function("luhn_check", digits)
        known = m.rlike("^[3-6]")
    elif kind == "phone":
        keep = n.between(7, 17)
        ok = n.between(9, 15)
        known = m.rlike(CALLING)
    else:
        keep, ok = F.lit(True), F.lit(False)
        names = list(FORMS)
        for k, name in enumerate(names[:-1]):
            form = F.when(m.rlike(f"^(?:{FORMS[name]})$"), len(KINDS) - 1 + k).otherwise(form) if k else F.when(m.rlike(f"^(?:{FORMS[name]})$"), len(KINDS) - 1).otherwise(len(KINDS) - 2 + len(names))
        of = lambda name: form == len(KINDS) - 1 + names.index(name)
        # being well formed speaks for a number, and says nothing of a date
        wrong = F.when(of("identity"), m.rlike("^(000|666|9)|-00-|-0000$")).when(of("national"), m.rlike(r"^\(?[01]")).when(of("date"), m.rlike(r"^([0-9]+[./-])(1[3-9]|[2-9][0-9])")).otherwise(F.lit(False))
        valid = F.when(wrong, -1).when(of("date"), 0).otherwise(1)
        known = F.when(of("account"), m.rlike(COUNTRIES)).when(of("written"), F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS))
        near = F.when(of("date"), _sign(cue == 1, cue != 1)).otherwise(near)
    separators = F.length(m) - F.length(F.regexp_replace(m, r"[ ().-]", ""))
    numbers = {
        "check": _sign(ok, ~ok) if valid is None else valid,
        "gazetteer": _sign(known, ~known),
        "context": near,
        "shape": _sign(F.lit(False), digits.rlike(r"^([0-9])\1{6,}$") | digits.rlike("^0*1?2345678")),
        "form": form,
        "digits": F.when(n < 4, 0).when(n < 8, 1).when(n < 11, 2).when(n < 14, 3).otherwise(4),
        "separators": F.least(separators, F.lit(3)),
        "cue": cue,
    }
    return keep, ok, numbers


def _found(kind: str, text: Column) -> Column:
    """Candidates of a kind with their places: pieces between the matches and the matches, added up."""

    def placed(m: Column, p: Column, ends: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            after = F.get(ends, i)
            keep, ok, numbers = _judged(kind, x, F.right(F.get(p, i), F.lit(CONTEXT)), F.left(F.get(p, i + 1), F.lit(CONTEXT)))
            return F.struct((after - F.length(x)).alias("start"), after.alias("end"), keep.alias("keep"), ok.alias("ok"), *(v.alias(k) for k, v in numbers.items()))

        return F.filter(F.transform(m, span).cast(SPAN), lambda s: s["keep"])

    def measured(m: Column) -> Column:
        return _let(F.split(text, PATTERNS[kind], -1), lambda p: _let(_running(F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x)), 0, lambda a, x: a + x), lambda ends: placed(m, p, ends)))

    none = F.array().cast(SPAN)
    found = _let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: F.when(F.size(m) > 0, measured(m)).otherwise(none))
    needs = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")), "phone": F.contains(text, F.lit("+"))}.get(kind)
    return found if needs is None else F.when(needs, found).otherwise(none)


def candidates(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys and a column for each kind: its candidates with their places and votes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(*keys, *(_found(k, whole).alias(f"c_{k}") for k in KINDS))


Counts = list[tuple[str, tuple[int, ...], int]]


def vote_counts(cands: DataFrame) -> Counts:
    """How often each kind has each combination of votes and features (see FEATURES: their number is bounded)."""
    def of(kind: str) -> Column:
        return F.transform(f"c_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), *(s[v].alias(v) for v in NUMBERS)))

    each = F.explode(F.flatten(F.array(*map(of, KINDS))))
    rows = cands.select(each.alias("s")).groupBy("s.kind", *(f"s.{v}" for v in NUMBERS)).agg(F.count("*").alias("n")).collect()
    return sorted((r["kind"], tuple(r[v] for v in NUMBERS), r["n"]) for r in rows)


def reliabilities(counts: Counts, rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation for two classes and labelers that vote independently given the class; forms have priors of their own.

    The probability that a candidate of each entry is personal.
    """
    if not counts:
        return np.zeros(0)
    votes = np.array([v[: len(LABELERS)] for _, v, _ in counts])
    form = np.array([v[len(LABELERS)] for _, v, _ in counts])
    n = np.array([c for *_, c in counts], float)
    soft = np.clip(0.5 + 0.2 * votes.sum(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = (np.bincount(form, soft * n, FEATURES["form"]) + 1) / (np.bincount(form, n, FEATURES["form"]) + 2)
        odds = np.log(prior[form] / (1 - prior[form]))
        for j in range(len(LABELERS)):
            p = np.ones((2, 3))  # a labeler that does not vote says nothing
            for label in (0, 1):
                mass = (soft if label else 1 - soft) * n
                for vote in (-1, 1):
                    # a labeler is taken to be right more often than wrong: pseudo-counts
                    hold = 4.0 if (vote > 0) == bool(label) else 1.0
                    p[label, vote + 1] = (mass[votes[:, j] == vote].sum() + hold) / (mass[votes[:, j] != 0].sum() + 5.0)
            odds += np.log(p[1] / p[0])[votes[:, j] + 1]
        soft = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return soft


def _columns(form: int, numbers: tuple[int, ...]) -> dict[str, int]:
    """Each group of weights and which of it a span has."""
    votes, rest = numbers[: len(LABELERS)], numbers[len(LABELERS) :]
    cue = rest[-1]
    return {**{k: v + 1 for k, v in zip(LABELERS, votes)}, **dict(zip(FEATURES, rest)), "both": form * FEATURES["cue"] + cue}


_GROUPS = {**{k: 3 for k in LABELERS}, **FEATURES, "both": FEATURES["form"] * FEATURES["cue"]}


def train(counts: Counts, soft: np.ndarray, steps: int = 500) -> dict[str, np.ndarray]:
    """Weights of a logistic classifier on votes and features, fitted to the soft labels (each combination weighs its log count)."""
    starts = dict(zip(_GROUPS, np.cumsum([0, *_GROUPS.values()])))
    x = np.zeros((len(counts), sum(_GROUPS.values())))
    for i, (_, numbers, _) in enumerate(counts):
        for name, k in _columns(numbers[len(LABELERS)], numbers).items():
            x[i, starts[name] + k] = 1
    mass = np.log1p([n for *_, n in counts])
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(counts) else 0):
        w = w * 0.999 + 1.0 * (x.T @ (mass * (soft - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))))) / mass.sum()
    return {name: w[at : at + _GROUPS[name]] for name, at in starts.items()}


def _probability(span: Column, weights: dict[str, np.ndarray]) -> Column:
    of = lambda name, k: F.get(F.array(*(F.lit(float(w)) for w in weights[name])), k)
    z = of("both", span["form"] * FEATURES["cue"] + span["cue"])
    for name in NUMBERS:
        z = z + of(name, span[name] + 1 if name in LABELERS else span[name])
    return 1 / (1 + F.exp(-z))


def _free(maybe: Column, base: Column) -> Column:
    """The spans of maybe that touch no base span, in order."""
    mark = lambda spans, b: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(b).alias("base")))
    every = F.array_sort(F.array_distinct(F.concat(mark(base, True), mark(maybe, False))))
    highest, lowest = lambda a, x: F.greatest(a, x), lambda a, x: F.least(a, x)

    def picked(all_: Column) -> Column:
        before = _running(F.transform(all_, lambda s: F.when(s["base"], s["end"]).otherwise(-1)), -1, highest)
        after = F.reverse(_running(F.reverse(F.transform(all_, lambda s: F.when(s["base"], s["start"]).otherwise((1 << 31) - 1))), (1 << 31) - 1, lowest))
        spans = F.transform(all_, lambda s: F.struct(F.lit("other").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return _let(before, lambda b: _let(after, lambda a: F.filter(spans, lambda s, i: ~F.get(all_, i)["base"] & (F.get(b, i) <= s["start"]) & (F.get(a, i) >= s["end"]))))

    return F.when(F.size(maybe) > 0, _let(every, picked)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))


def find(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """The keys, and two arrays of (kind, start, end): base spans, and all spans with those that the classifier adds.

    By kind as in KINDS, then by start.  Candidates are staged, since they are
    counted first and classified then.
    """
    cands = staged(candidates(df, text, keys), "pii")
    counts = vote_counts(cands)
    weights = train(counts, reliabilities(counts))

    def span(kind: str, s: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    def sure(kind: str) -> Column:
        return F.transform(F.filter(f"c_{kind}", lambda s: s["ok"]), lambda s: span(kind, s))

    likely = F.transform(F.filter("c_other", lambda s: _probability(s, weights) >= ADDED_FROM), lambda s: span("other", s))
    out = cands.select(*keys, F.flatten(F.array(*map(sure, KINDS[:-1]))).alias(base), likely.alias("__maybe"))
    return out.select(*keys, base, F.concat(F.col(base), _free(F.col("__maybe"), F.col(base))).alias(spans))
