"""Personal data: overlapping candidates, boosted trees over their format and context, calibrated thresholds.

Base spans (e-mail addresses, IP addresses, card and phone numbers of strict form) always stay. Generators of high recall propose
looser candidates that overlap them and each other: any run of digits with marks between, any word at a word, any long run
of letters and digits (what secrets look like). Candidates that overlap a base span, or follow a name like "token =", are labelled;
all others are unlabelled, not negative. Gradient-boosted trees learn, from format and context without the very marks that make a
base span strict (the plus sign, the separators, check digits, how "at" is written, the name of a secret), how likely a candidate
is labelled. If strict forms are a share c of a kind, measured as the mean score of labelled candidates in documents the trees
have not seen, an unlabelled candidate of score g is of the kind with a probability of (1 - c) / c * g / (1 - g). Each kind's
threshold is the lowest score from which on these probabilities promise ``PRECISION``; candidates above it that do not
overlap a base span are added.

All of it is DataFrame expressions, linear in the length of a text but for a root of its number of matches; the trees
are fitted from counts of feature patterns, whose number is bounded by the levels of the features, and become CASE expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import materialise

KINDS = ["email", "ip", "card", "phone"]
#: The kinds of spans in their order; secrets have no base form and are only added.
ALL_KINDS = [*KINDS, "secret"]

# The base forms. Anchors and possessive loops make each linear in the length of the text; the matches are
# those of the plain forms, leftmost and not overlapping.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The loose forms.
LOOSE = {
    "number": r"(?<![0-9A-Za-z])(?<![0-9][\x20./-])[+(]?[0-9](?:[\x20./()-]{0,2}[0-9])++",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.(?=[A-Za-z0-9-])|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "token": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+",
}
AT, DOT = r"\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20", r"\x20?(?:\.|\(dot\)|\[dot\])\x20?|\x20dot\x20"
NAMED_SECRET = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key)[\x22\x27]?\x20{0,2}[:=]\x20{0,2}[\x22\x27]?$"
CONTEXT = 24
CONTEXT_WORDS = [r"tel|phone|call|fax|mobil|whatsapp|sms", r"card|visa|master|credit|amex|karte|carte|tarjeta", r"\bip\b|server|host|addr|login", r"mail|contact|write to"]

#: Boosting rounds, their rate, and the levels below which trees split.
ROUNDS, RATE, DEPTH = 30, 0.3, 2
#: Share of a kind's additions that are expected to be of it.
PRECISION = 0.9
#: One document in so many calibrates the thresholds.
CALIBRATION = 5

_SIDES = {"before": [1, 2, 3], "after": [1, 2, 3]}
FEATURES = {
    "number": {"digits": [7, 9, 10, 12, 13, 16, 17, 20], "groups": [2, 3, 4, 5, 6], "longest": [3, 4, 5, 6, 8, 12], "context": [1, 2, 3, 4]} | _SIDES,
    "address": {"parts": [2, 3, 4], "tail": [2, 3, 4, 6], "local": [2, 4, 8, 16], "domain": [2, 4, 8, 16], "context": [1, 2, 3, 4]} | _SIDES,
    "token": {"length": [20, 24, 32, 33, 40, 41, 64, 65, 128], "digits": [2, 4, 6, 8, 12, 24], "upper": [1, 3, 6], "marks": [1, 2, 4], "run": [4, 6, 9]} | _SIDES,
}
#: The kinds each family of candidates may be; of overlapping candidates of different families, the first family's stays.
FAMILIES = {"address": ["email"], "token": ["secret"], "number": ["ip", "card", "phone"]}
MATCH = "array<struct<start:int,end:int,found:string,before:string,after:string>>"
SPANS = "array<struct<start:int,nth:int,end:int,kind:string>>"

# Expressions are written as SQL text: a tree of thousands of nodes is parsed at once, not made by a call for each node.

Sql = str
_names = count()


def _lambda(body: Callable[..., Sql], n: int) -> Sql:
    names = [f"v{next(_names)}" for _ in range(n)]
    return f"{names[0] if n == 1 else '(' + ', '.join(names) + ')'} -> {body(*names)}"


def each(xs: Sql, body: Callable[..., Sql], n: int = 1) -> Sql:
    """``body`` of every element (and of its place, from 0, with ``n`` 2)."""
    return f"transform({xs}, {_lambda(body, n)})"


def only(xs: Sql, test: Callable[[Sql], Sql]) -> Sql:
    return f"filter({xs}, {_lambda(test, 1)})"


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """``body`` of a value that is computed once, however often, and in however many lambdas, it is used."""
    return f"get({each(f'array({value})', body)}, 0)"


def text_of(pattern: str) -> Sql:
    """A pattern as a literal."""
    return f"r'{pattern}'"


def total(xs: Sql) -> Sql:
    return f"aggregate({xs}, 0, {_lambda(lambda a, x: f'{a} + {x}', 2)})"


def largest(xs: Sql) -> Sql:
    return f"array_max({xs})"


def running(xs: Sql, over: Callable[[Sql], Sql]) -> Sql:
    """``over`` (a sum or a maximum) of each element and all before it, by way of blocks of about the root of their number."""

    def of(xs: Sql) -> Sql:
        def blocks(step: Sql) -> Sql:
            sums = each(f"sequence(0, int((size({xs}) - 1) div {step}))", lambda b: over(f"slice({xs}, {b} * {step} + 1, {step})"))
            own = lambda i: f"slice({xs}, int({i} div {step}) * {step} + 1, {i} % {step} + 1)"
            before = lambda s: each(s, lambda x, b: f"if({b} = 0, null, {over(f'slice({s}, 1, {b})')})", 2)
            joined = lambda s, i: over(f"filter(concat(array(get({s}, int({i} div {step}))), {own(i)}), y -> y is not null)")
            return let(let(sums, before), lambda s: each(xs, lambda _, i: joined(s, i), 2))

        return f"if(size({xs}) > 0, {let(f'int(ceil(sqrt(size({xs}))))', blocks)}, cast(array() as array<int>))"

    return let(xs, of)


def matches(text: Sql, pattern: str) -> Sql:
    """Array of all matches: start, end (in code points), found, and what is around: up to ``CONTEXT`` characters before, one after
    (both as far as the gaps to the neighbouring matches and these matches show)."""

    def of(found: Sql, gaps: Sql) -> Sql:
        sizes = each(found, lambda m, i: f"char_length({m}) + char_length(get({gaps}, {i}))", 2)

        def one(m: Sql, i: Sql, ends: Sql) -> Sql:
            tail = lambda c: f"coalesce(right({c}, {CONTEXT}), '')"
            before = f"right(concat({tail(f'get({found}, {i} - 1)')}, {tail(f'get({gaps}, {i})')}), {CONTEXT})"
            after = f"left(concat(left(get({gaps}, {i} + 1), 1), coalesce(left(get({found}, {i} + 1), 1), '')), 1)"
            return f"named_struct('start', get({ends}, {i}) - char_length({m}), 'end', get({ends}, {i}), 'found', {m}, 'before', {before}, 'after', {after})"

        return let(running(sizes, total), lambda ends: each(found, lambda m, i: one(m, i, ends), 2))

    every = let(f"regexp_extract_all({text}, {text_of(pattern)}, 0)", lambda found: let(f"split({text}, {text_of(pattern)}, -1)", lambda gaps: of(found, gaps)))
    return f"if({text} rlike {text_of(pattern)}, {every}, cast(array() as {MATCH}))"


def luhn(digits: Sql) -> Sql:
    """Whether a string of digits passes the Luhn test."""
    worth = lambda c, i: let(f"int({c}) * (1 + {i} % 2)", lambda d: f"if({d} > 9, {d} - 9, {d})")
    return f"coalesce({total(each(f'split(reverse({digits}), {text_of("(?<=.)(?=.)")})', worth, 2))} % 10 = 0, false)"


def _octet(part: Sql) -> Sql:
    return let(f"regexp_replace({part}, '^0+', '')", lambda short: f"char_length({short}) <= 3 and coalesce(try_cast({short} as int), 0) <= 255")


def _digits(found: Sql) -> Sql:
    return f"regexp_replace({found}, '[^0-9]', '')"


def valid(kind: str, found: Sql) -> Sql:
    if kind == "ip":
        return f"forall(split({found}, {text_of('[.]')}), {_lambda(_octet, 1)})"
    if kind == "card":
        return luhn(_digits(found))
    if kind == "phone":
        return f"char_length({_digits(found)}) between 9 and 15"
    return "true"


def _cheap(kind: str) -> Sql:
    """What texts with a match hold, told without a search for the whole form."""
    at = r"@|\(at\)|\[at\]|\x20dot\x20"
    return {"email": "contains(text, '@')", "phone": "contains(text, '+')", "address": f"text rlike {text_of(at)}"}.get(kind, "numbers")


def _binned(value: Sql, edges: list[int]) -> Sql:
    return let(value, lambda v: f"size({only(f'array({", ".join(map(str, edges))})', lambda e: f'{v} >= {e}')})")


def _side(char: Sql) -> Sql:
    """0 at the edge or white space, 1 letter or digit, 2 quote, bracket or equals sign, 3 another mark."""
    kinds = [(r"^\s*$", 0), (r"^[\p{L}\p{N}]$", 1), (r"^[\x22\x27()\[\]{}<>=:]$", 2)]
    return let(char, lambda c: "case " + " ".join(f"when {c} rlike {text_of(p)} then {n}" for p, n in kinds) + " else 3 end")


def _raw_features(family: str, c: Sql) -> dict[str, Sql]:
    found = f"{c}.found"
    raw = {"before": _side(f"right({c}.before, 1)"), "after": _side(f"{c}.after")}
    if family != "token":
        raw["context"] = let(f"lower({c}.before)", lambda b: "case " + " ".join(f"when {b} rlike {text_of(p)} then {i + 1}" for i, p in enumerate(CONTEXT_WORDS)) + " else 0 end")
    if family == "number":
        groups = f"split(regexp_replace({found}, '^[+(]', ''), '[^0-9]+')"
        return raw | {"digits": f"char_length({_digits(found)})", "groups": f"size({groups})", "longest": f"array_max({each(groups, lambda g: f'char_length({g})')})"}
    if family == "address":
        halves = f"split({found}, {text_of(AT)}, 2)"
        parts = f"split(get({halves}, 1), {text_of(DOT)})"
        return raw | {"parts": f"size({parts})", "tail": f"char_length(element_at({parts}, -1))", "local": f"char_length(get({halves}, 0))", "domain": f"char_length(get({parts}, 0))"}
    n = f"char_length({found})"
    of = lambda marks: f"{n} - char_length(regexp_replace({found}, '{marks}', ''))"
    letters = each(f"split({found}, '[^A-Za-z]+')", lambda g: f"char_length({g})")
    return raw | {"length": n, "digits": of("[0-9]"), "upper": of("[A-Z]"), "marks": of("[_+/-]"), "run": f"array_max({letters})"}


def _span(start: Sql, nth: Sql, end: Sql, kind: Sql) -> Sql:
    return f"named_struct('start', {start}, 'nth', {nth}, 'end', {end}, 'kind', {kind})"


def _strict(kind: str, found: Sql) -> Sql:
    """The matches of a kind's base form that are valid, as base spans."""
    passed = only(found, lambda m: valid(kind, f"{m}.found"))
    return each(passed, lambda m: _span(f"{m}.start", str(KINDS.index(kind)), f"{m}.end", f"'{kind}'"))


def overlapping(spans: Sql, c: Sql) -> Sql:
    """The first of ``spans`` (disjoint, in order) that ends after ``c`` begins, if it begins before ``c`` ends; by halving."""

    def halve(a: Sql, _: Sql) -> Sql:
        cut = lambda m: f"if(get({spans}, {m}).end > {c}.start, named_struct('low', {a}.low, 'high', {m}), named_struct('low', {m} + 1, 'high', {a}.high))"
        return f"if({a}.low >= {a}.high, {a}, {let(f'int(({a}.low + {a}.high) div 2)', cut)})"

    at = f"aggregate(sequence(0, int(floor(log2(size({spans}) + 1)))), named_struct('low', 0, 'high', size({spans})), {_lambda(halve, 2)}, {_lambda(lambda a: f'{a}.low', 1)})"
    return f"if(size({spans}) > 0, {let(f'get({spans}, {at})', lambda s: f'if({s}.start < {c}.end, {s}, null)')}, null)"


def _described(family: str, found: Sql, base: dict[str, Sql]) -> Sql:
    """A family's candidates with their features, and the kind of the base span they overlap ("secret": of a name before), if any."""

    def one(c: Sql) -> Sql:
        named = [f"if(lower({c}.before) rlike {text_of(NAMED_SECRET)}, 'secret', null)"] if family == "token" else []
        label = ", ".join([*[f"{overlapping(base[kind], c)}.kind" for kind in KINDS], *named, "'none'"])
        raw = _raw_features(family, c)
        features = ", ".join(f"'{k}', {_binned(raw[k], e)}" for k, e in FEATURES[family].items())
        return f"named_struct('start', {c}.start, 'end', {c}.end, 'label', coalesce({label}), {features})"

    return each(found, one)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each document's base spans and loose candidates, with features and the kind of the base span they overlap, if any."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("numbers", F.col("text").rlike("[0-9]"))
    found = lambda kind, pattern: f"if({_cheap(kind)}, {matches('text', pattern)}, cast(array() as {MATCH}))"
    every = ", ".join([*[f"'{k}', {_strict(k, found(k, BASE[k]))}" for k in KINDS], *[f"'{f}', {found(f, LOOSE[f])}" for f in FAMILIES]])

    def described(s: Sql) -> Sql:
        families = ", ".join(f"'{f}', {_described(f, f'{s}.{f}', {k: f'{s}.{k}' for k in KINDS})}" for f in FAMILIES)
        return f"named_struct('base', array_sort(concat({', '.join(f'{s}.{k}' for k in KINDS)})), {families})"

    return own.select("id", F.expr(let(f"named_struct({every})", described)).alias("found"))


class Boosted:
    """Gradient-boosted trees of a logistic score over integer features, as CASE expressions."""

    def __init__(self, x: np.ndarray, positive: np.ndarray, negative: np.ndarray, names: list[str]):
        self.names, self.trees = names, []
        self.base = math.log((positive.sum() + 0.5) / (negative.sum() + 0.5))
        score, all_rows = np.full(len(x), self.base), positive + negative
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, positive - all_rows * p, all_rows * p * (1 - p), DEPTH)
            self.trees.append(tree)
            score = score + self._leaves(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = RATE * float(g.sum()) / (float(h.sum()) + 1)
        best = (1e-6, None)
        if depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[:, f])[1:]:
                    low = x[:, f] < cut
                    parts = [(g[m].sum(), h[m].sum()) for m in (low, ~low)]
                    gain = sum(a * a / (b + 1) for a, b in parts) - g.sum() ** 2 / (h.sum() + 1)
                    if gain > best[0]:
                        best = (gain, (f, int(cut), low))
        if best[1] is None:
            return leaf
        f, cut, low = best[1]
        return f, cut, self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1)

    def _leaves(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] < tree[1], self._leaves(tree[2], x), self._leaves(tree[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._leaves(t, x) for t in self.trees)

    def sql(self, candidate: Sql) -> Sql:
        def of(tree) -> Sql:
            if not isinstance(tree, tuple):
                return f"{float(tree)!r}D"
            return f"if({candidate}.{self.names[tree[0]]} < {tree[1]}, {of(tree[2])}, {of(tree[3])})"

        return " + ".join([f"{float(self.base)!r}D", *map(of, self.trees)])


def threshold(score: np.ndarray, n: np.ndarray, labelled: np.ndarray, open_: np.ndarray) -> float | None:
    """The lowest score from which on ``PRECISION`` of the unlabelled (``open_``) candidates are expected to be of the kind, given the
    scores of ``n`` candidates of each pattern, of which ``labelled`` are known to be of it."""
    g = np.clip(1 / (1 + np.exp(-score)), 1e-9, 1 - 1e-9)
    if not (known := float((n * labelled).sum())) or not (n * open_).sum():
        return None
    c = float((n * labelled * g).sum()) / known
    promise = np.minimum(1, (1 - c) / c * g / (1 - g)) * n * open_
    order = np.argsort(-score, kind="stable")
    kept, share = np.cumsum((n * open_)[order]), np.cumsum(promise[order])
    last = np.append(score[order][1:] != score[order][:-1], True)  # patterns of one score stand or fall together
    good = last & (kept > 0) & (share >= PRECISION * kept)
    return float(score[order][np.flatnonzero(good)[-1]]) - 1e-9 if good.any() else None  # sums round differently in SQL


def fit(found: DataFrame) -> dict[str, list[tuple[str, Boosted, float]]]:
    """family: (kind, trees, threshold) of each of its kinds that has a threshold of enough precision."""
    models: dict[str, list] = {}
    for family, kinds in FAMILIES.items():
        names = list(FEATURES[family])
        rows = found.select((F.crc32(F.col("id").cast("string")) % CALIBRATION == 0).alias("held"), F.explode(f"found.{family}").alias("c")).select(F.coalesce("held", F.lit(False)).alias("held"), "c.label", *[f"c.{n}" for n in names])
        counts = rows.groupBy(*rows.columns).count().orderBy(*rows.columns).collect()  # bounded by the levels of the features
        if not counts:
            continue
        x = np.array([[r[n] for n in names] for r in counts])
        n, held, label = np.array([r["count"] for r in counts], float), np.array([r["held"] for r in counts]), np.array([r["label"] for r in counts])
        for kind in kinds:
            is_kind, fitted = label == kind, ~held
            if not (is_kind & fitted).any():
                continue
            trees = Boosted(x[fitted], np.where(is_kind, n, 0)[fitted], np.where(is_kind, 0, n)[fitted], names)
            unseen = held if (is_kind & held).any() else fitted
            # secrets have no base form: a candidate with the name of one before it is a finding like the others
            finding = is_kind if kind not in KINDS else np.zeros(len(x), bool)
            cut = threshold(trees.score(x)[unseen], n[unseen], is_kind[unseen], ((label == "none") | finding)[unseen])
            if cut is not None:
                models.setdefault(family, []).append((kind, trees, cut))
    return models


def _added(family: str, models: list[tuple[str, Boosted, float]]) -> Sql:
    """A family's candidates over the threshold of a kind that overlap no base span: the kind by which they are furthest over it."""

    def best(c: Sql) -> Sql:
        over = ", ".join(f"named_struct('over', {trees.sql(c)} - {cut!r}D, 'nth', {-ALL_KINDS.index(kind)}, 'kind', '{kind}')" for kind, trees, cut in models)
        return f"array_max({only(f'array({over})', lambda o: f'{o}.over >= 0')})"

    span = lambda c, b: f"if({c}.label in ('none', 'secret') and {b} is not null, {_span(f'{c}.start', f'-{b}.nth', f'{c}.end', f'{b}.kind')}, null)"
    return only(each(f"found.{family}", lambda c: let(best(c), lambda b: span(c, b))), lambda c: f"{c} is not null")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base`` and ``spans`` for each row: arrays of (start, nth, end, kind) in the order of start and kind.

    ``spans`` are the base spans and what the method adds; offsets are code points, ends exclusive. Null texts count as
    empty; null ids and repeated rows are rows like others. Of overlapping additions those of the first family in ``FAMILIES``
    stay. Texts of any length are searched as a whole. An empty table gives none.
    """
    found = materialise(candidates(docs, id_col, text_col), "pii")
    models = fit(found)
    additions = ", ".join(f"'{f}', " + (_added(f, models[f]) if f in models else f"cast(array() as {SPANS})") for f in FAMILIES)

    def together(s: Sql) -> Sql:
        def apart(c: Sql, i: int) -> Sql:
            return " and ".join(["true", *[f"{overlapping(f'{s}.{other}', c)} is null" for other in list(FAMILIES)[:i]]])

        kept = [only(f"{s}.{f}", lambda c, i=i: apart(c, i)) for i, f in enumerate(FAMILIES)]
        return f"array_sort(concat({', '.join(['found.base', *kept])}))"

    spans = F.expr(let(f"named_struct({additions})", together))
    return found.select(F.col("id").alias(id_col), F.col("found.base").alias("base"), spans.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of :func:`find_pii` in ``text_col`` replaced by their kind in brackets; of spans that overlap, by the
    first one's. Null texts stay null; rows with equal ids are rows like others. An empty table gives none."""
    rows = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("nth")), "pii-rows")
    spans = find_pii(rows.select("nth", F.col("row").getField(text_col).alias("text")), "nth", "text").select(F.col("nth").alias("of"), "spans")

    def cut(chars: Sql, covered: Sql) -> Sql:
        until = lambda i: f"coalesce(get({covered}, {i} - 1), 0)"
        piece = lambda s, i: f"if({s}.start < {until(i)}, '', concat(array_join(slice({chars}, {until(i)} + 1, {s}.start - {until(i)}), ''), '[', {s}.kind, ']'))"
        rest = f"array_join(slice({chars}, element_at({covered}, -1) + 1, size({chars})), '')"
        return f"concat(array_join({each('spans', piece, 2)}, ''), {rest})"

    chars = f"split(_text, {text_of('(?s)(?<=.)(?=.)')})"
    shown = let(chars, lambda c: let(running(each("spans", lambda s: f"{s}.end"), largest), lambda covered: cut(c, covered)))
    done = rows.join(spans, F.col("nth") == F.col("of")).withColumn("_text", F.col("row").getField(text_col)).withColumn("_shown", F.expr(f"if(size(spans) > 0, {shown}, _text)"))
    return done.select(*[(F.col("_shown") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
