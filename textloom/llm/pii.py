"""Personal data by candidate gradient boosting, in DataFrame expressions only.

High-recall generators (regular expressions) propose overlapping candidate spans per kind. A candidate that passes its
kind's base rule is always a span. Every other candidate is described by features of its format and its context, scored by
boosted trees, and selected if its score reaches the kind's calibrated threshold; of overlapping ones the best is taken.

The trees are fitted once per process, to candidates of texts that `training_texts` makes from a seed; their features come
from the same expressions as in production. The fitted trees are plain CASE expressions: nothing but Spark SQL runs on the
executors, within a row, and nothing is shuffled.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Base patterns are written so that no run of characters is scanned again and again: a match starts where a run starts or the last match ended.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter chains of digits fail the rule and hold no candidate
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_HEX = "[0-9A-Fa-f]{1,4}"

#: Further generators per kind. They may overlap each other and the base matches.
GENERATORS = {
    "email": (
        r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}|<at>) ?[A-Z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}|<dot>) ?[A-Z0-9-]{1,63}+){1,6}+",
        r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+ at [A-Z0-9-]{1,63}+(?: dot [A-Z0-9-]{1,63}+){1,6}+",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?@ ?[A-Za-z0-9-]{1,63}+ ?\. ?[A-Za-z]{2,10}+(?![A-Za-z0-9-])",
    ),
    "ip": (
        rf"(?<![0-9A-Za-z:.]){_HEX}(?::{_HEX}){{7}}(?![0-9A-Za-z:])",
        rf"(?<![0-9A-Za-z:.])(?:{_HEX}:){{1,7}}(?::{_HEX}){{1,6}}(?![0-9A-Za-z:])",
        r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9.])",
        r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])",
    ),
    "card": (
        r"(?<![0-9])[0-9]{4}([ .\-/_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        r"(?<![0-9])3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5}(?![0-9])",
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9A-Za-z+.])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])",
        r"(?<![0-9A-Za-z+.])00[1-9][0-9]{0,2}(?:[ ().\-]{0,2}[0-9]){7,13}(?![0-9])",
        r"(?<![0-9A-Za-z+.])\(?0[1-9][0-9]{1,4}\)?(?:[ .\-/]{1,3}[0-9]{2,8}){1,5}(?![0-9])",
        r"\+ ?[0-9]{1,3}(?:[ ().\-/]{0,3}[0-9]){7,12}(?![0-9])",
        r"(?<![0-9A-Za-z+.])[0-9]{7,12}(?![0-9])",
    ),
}
BEFORE, AFTER = 32, 12  # characters of context
_CUES = {
    "cue_email": r"(?i)\b(?:e-?mail|mail|correo|courriel|contact|write to|reach|kontakt)\b",
    "cue_ip": r"(?i)\b(?:ip|ipv4|ipv6|address|host|server|login from|client|adresse|connected from)\b",
    "cue_card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|cc|payment|karte|tarjeta|carte|pan)\b",
    "cue_phone": r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|whatsapp|sms|telefon|handy|tél|teléfono|ring|dial)\b",
    "cue_other": r"(?i)(?:\b(?:order|invoice|version|ver|isbn|issn|id|ids|no|nr|ref|serial|page|total|build|sku|ticket|item|part|code|batch|date|release|chapter|section|score|population|batch|row)\b|[#$€£v])[\s:.#]{0,3}$",
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a plain reference in a lambda may be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


_SPAN = "s:int,e:int,v:string,l:string,r:string"


def spans_of(text: Column, pattern: str) -> Column:
    """All matches of a pattern as array<struct<s, e, v, l, r>>: places in code points, end exclusive, the match, and its context.

    The pieces between the matches give the places and the context. Their lengths are summed in blocks, so a text with many
    matches needs no running array, and no expression reads the whole text once per match.
    """
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(f"array<struct<{_SPAN}>>")).otherwise(let(F.split(text, pattern, -1), lambda gaps: _places(found, gaps))))


def _places(found: Column, gaps: Column) -> Column:
    n = F.size(found)
    block = F.ceil(F.sqrt(n)).cast("int")
    ends = F.transform(found, lambda v, i: F.length(gaps[i]) + F.length(v))  # from the end of the match before to the end of this one
    near = lambda i: F.coalesce(F.try_element_at(found, i), F.lit(""))

    def place(v: Column, i: Column, e: Column, sums: Column, size: Column) -> Column:
        k = F.floor(i / size).cast("int")
        left = F.right(F.concat(F.when(i > 0, near(F.greatest(i, F.lit(1)))).otherwise(""), gaps[i]), F.lit(BEFORE))
        right = F.left(F.concat(gaps[i + 1], near(i + 2)), F.lit(AFTER))
        return let(_total(F.slice(sums, F.lit(1), k)) + _total(F.slice(e, k * size + 1, i % size + 1)), lambda end: F.struct((end - F.length(v)).alias("s"), end.alias("e"), v.alias("v"), left.alias("l"), right.alias("r")))

    def blocks(e: Column, size: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda b: _total(F.slice(e, b * size + 1, size))), lambda sums: F.transform(found, lambda v, i: place(v, i, e, sums, size)))

    return let(ends, lambda e: let(block, lambda size: blocks(e, size)))


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn's sum of a string of digits is a multiple of 10."""

    def weigh(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).try_cast("int")
        return F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return (F.length(d) > 0) & (_total(F.transform(F.sequence(F.lit(0), F.greatest(F.length(d) - 1, F.lit(0))), weigh)) % 10 == 0)


def passes(kind: str, v: Column) -> Column:
    """The base rule of a kind."""
    if kind == "ip":
        return v.rlike(_OCTETS)
    if kind == "card":
        return let(digits_of(v), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits_of(v)).between(8, 15)
    return F.lit(True)


def plausible(kind: str, v: Column) -> Column:
    """Failed base matches that the trees may look at; others hold nothing that the generators don't find themselves."""
    n = F.length(digits_of(v))
    return n.between(13, 19) if kind == "card" else n.between(7, 15) if kind == "phone" else F.lit(False)


def masked(text: Column, matches: Column, kind: str) -> Column:
    """The text with its base spans overwritten, character for character, so that no other generator finds them again."""
    pieces = F.split(text, BASE[kind], -1)
    cover = lambda x: F.when(passes(kind, x.v), F.repeat(F.lit("\x01"), F.length(x.v))).otherwise(x.v)
    return F.when(F.size(matches) == 0, text).otherwise(let(pieces, lambda p: F.concat(F.array_join(F.transform(matches, lambda x, i: F.concat(p[i], cover(x))), ""), F.element_at(p, -1))))


def candidates(text: Column, kind: str, matches: Column) -> Column:
    """Candidates that are no base spans and overlap none: failed base matches and the finds of the other generators."""
    failed = F.filter(matches, lambda x: ~passes(kind, x.v) & plausible(kind, x.v))
    return let(masked(text, matches, kind), lambda t: F.concat(failed, *(spans_of(t, p) for p in GENERATORS[kind])))


#: Numeric features of a candidate, by name.
FEATURES = (
    "length", "n_digits", "n_seps", "n_alpha", "n_groups", "first_digit", "n_distinct", "luhn", "octets", "plus", "bracket_at", "spelled_dot", "colons", "parens",
    "spaced_sign", "tld", "joined_left", "joined_right", *_CUES,
)


def features(c: Column) -> Column:
    """array<double> of FEATURES for a candidate."""
    v, d, left, right = c.v, digits_of(c.v), c.l, c.r
    num = lambda x: x.cast("double")
    count = lambda p: num(F.regexp_count(v, F.lit(p)))
    values = {
        "length": num(F.length(v)), "n_digits": num(F.length(d)), "n_seps": count(r"[ .\-/()]"), "n_alpha": count("[A-Za-z]"), "n_groups": count("[0-9]+"),
        "first_digit": F.coalesce(F.substring(d, 1, 1).try_cast("double"), F.lit(-1.0)), "n_distinct": num(F.size(F.array_distinct(F.split(d, "")))), "luhn": F.coalesce(num(luhn(d)), F.lit(0.0)),
        "octets": num(v.rlike(_OCTETS)), "plus": num(v.startswith("+")), "bracket_at": num(v.rlike(r"(?i)[\[({<]at[\])}>]")), "spelled_dot": num(v.rlike(r"(?i)\bdot\b")),
        "colons": count(":"), "parens": count("[()]"), "spaced_sign": num(v.rlike(r" [@.]|[@.] ")), "tld": num(v.rlike(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|info|eu)$")),
        "joined_left": num(left.rlike(r"[A-Za-z0-9_\-./=:]$")), "joined_right": num(right.rlike(r"^[A-Za-z0-9_\-/=:%]|^\.[0-9]")),
        **{k: num(left.rlike(p)) for k, p in _CUES.items()},
    }
    return F.array(*(values[k] for k in FEATURES))


# -- boosted trees -----------------------------------------------------------------------------------------------------
def training_texts(seed: int = 13, n: int = 1600) -> list[tuple[str, int, int, str | None]]:
    """Sentences with one item each: (text, start, end, kind or None if the item is no personal data)."""
    r, out = random.Random(seed), []
    words = "the a report was sent with of and this for under new old some more les des und mit para con very data small large found moved often".split()
    dg = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(k: int, first: str, good: bool) -> str:
        body = first + dg(k - len(first) - 1)
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(body))))
        check = -total % 10
        return body + str(check if good else (check + r.randint(1, 9)) % 10)

    group = lambda s, sep, sizes: sep.join(s[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    name = lambda: r.choice(["anna", "j.smith", "max_m", "lee", "info", "maria.k", "tom99"])
    host = lambda: r.choice(["example", "mail", "uni-x", "corp", "shop"])
    tld = lambda: r.choice(["com", "org", "de", "net", "fr", "io"])
    octets = lambda sep: sep.join(str(r.randint(1, 254)) for _ in range(4))
    hexes = lambda k: ":".join(f"{r.randrange(16**4):x}" for _ in range(k))
    good = {
        "email": (lambda: f"{name()} [at] {host()}.{tld()}", lambda: f"{name()}(at){host()}(dot){tld()}", lambda: f"{name()} at {host()} dot {tld()}", lambda: f"{name()} @ {host()}.{tld()}", lambda: f"{name()} [at] {host()} [dot] {tld()}"),
        "ip": (lambda: hexes(8), lambda: f"{hexes(3)}::{hexes(2)}", lambda: f"{hexes(1)}::{hexes(1)}", lambda: octets("[.]"), lambda: f"2001:db8::{r.randrange(9999):x}"),
        "card": (lambda: card(15, r.choice(["34", "37"]), True), lambda: group(card(15, r.choice(["34", "37"]), True), r.choice(" -"), (4, 6, 5)), lambda: group(card(16, r.choice(["4", "51", "6011"]), True), ".", (4, 4, 4, 4)), lambda: "20" + dg(2) + " " + group(card(16, "4", True), " ", (4, 4, 4, 4))),
        "phone": (lambda: f"{r.randint(201, 989)}-{dg(3)}-{dg(4)}", lambda: f"({r.randint(201, 989)}) {dg(3)}-{dg(4)}", lambda: f"0049 {dg(3)} {dg(7)}", lambda: f"0{r.randint(10, 99)} {dg(2)} {dg(2)} {dg(2)} {dg(2)}", lambda: f"0{r.randint(100, 999)}/{dg(7)}", lambda: f"00{r.randint(30, 49)}{dg(9)}"),
    }
    bad = (
        lambda: dg(r.randint(7, 12)), lambda: dg(r.randint(13, 19)), lambda: f"{r.randint(1, 20)}.{r.randint(0, 40)}.{r.randint(0, 9)}.{r.randint(256, 9999)}", lambda: f"{dg(3)}.{dg(3)}.{dg(3)}.{r.randint(256, 999)}",
        lambda: f"20{dg(2)}-{dg(2)}-{dg(2)}", lambda: f"978-{dg(1)}-{dg(4)}-{dg(4)}-{dg(1)}", lambda: f"{r.choice(words)} at {r.choice(words)}", lambda: f"{dg(2)}:{dg(2)}:{dg(2)}", lambda: ":".join(f"{r.randrange(256):02x}" for _ in range(6)),
        lambda: group(card(16, r.choice("123456789"), False), r.choice([" ", "-", "."]), (4, 4, 4, 4)), lambda: f"{dg(3)} {dg(3)} {dg(4)}", lambda: card(15, "34", False), lambda: f"0{dg(2)} {dg(3)}", lambda: f"20{dg(2)} 20{dg(2)} 20{dg(2)} 20{dg(2)}",
        lambda: f"{r.choice(words)}@{r.choice(words)}", lambda: f"{dg(3)}.{dg(3)}.{dg(3)}", lambda: f"v{r.randint(0, 9)} . {r.randint(0, 9)} . {r.randint(0, 9)} . {r.randint(0, 9)}", lambda: f"0{dg(6)}", lambda: "+" + dg(5),
    )
    cues = {"email": ["email", "mail:", "contact", "write to"], "ip": ["IP", "host", "from server", "address"], "card": ["card", "Visa", "credit card no", "payment by"], "phone": ["phone", "Tel.", "call", "mobile:", "fax"]}
    other = ["order", "invoice no.", "version", "ISBN", "id", "ref", "#", "serial", "total", "page", "code", "item", "row", "build", "$"]
    for _ in range(n):
        kind = r.choice([*KINDS, None, None, None, None, None])
        pre, post = " ".join(r.choices(words, k=r.randint(1, 8))), " ".join(r.choices(words, k=r.randint(0, 6)))
        item = r.choice(good[kind] if kind else bad)()
        cue = r.choice(cues[kind]) if kind and r.random() < 0.8 else r.choice(other) if not kind and r.random() < 0.6 else r.choice(words)
        if kind == "phone" and cue in words and r.random() < 0.5:
            cue = "phone"
        head = f"{pre} {cue} "
        out.append((f"{head}{item}{r.choice([' ', '. ', ', '])}{post}", len(head), len(head) + len(item), kind))
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> tuple[float, list]:
    """Gradient boosting of the logistic loss: second-order leaf values, exact splits. A tree is (feature, threshold, low, high) or a leaf value."""
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 1e-3
    start = float(np.log(mean / (1 - mean)))
    raw, grown = np.full(len(y), start), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        value = -g[rows].sum() / (h[rows].sum() + ridge) * rate
        if not left or len(rows) < 8:
            return round(float(value), 5)
        best = (1e-6, None, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            gs, hs, xs = np.cumsum(g[order]), np.cumsum(h[order]), x[order, f]
            cut = np.flatnonzero(xs[1:] > xs[:-1])
            if len(cut):
                gain = gs[cut] ** 2 / (hs[cut] + ridge) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + ridge) - whole
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(xs[cut[k]] + xs[cut[k] + 1]) / 2)
        if best[1] is None:
            return round(float(value), 5)
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    def apply(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], apply(tree[2], x), apply(tree[3], x))

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p) + 1e-9, depth)
        grown.append(tree)
        raw = raw + apply(tree, x)
    return start, grown


def tree_scores(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    return np.array([model[0] + sum(value(t, row) for t in model[1]) for row in x])


def as_column(model: tuple[float, list], f: Column) -> Column:
    """The model's raw score as CASE expressions over an array of features."""

    def case(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(f[tree[0]] <= tree[1], case(tree[2])).otherwise(case(tree[3]))

    total = F.lit(model[0])
    for t in model[1]:
        total = total + case(t)
    return total


def threshold_for(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on the share of positives is at least `precision`; above all scores if there is none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(scores[order][1:] < scores[order][:-1], True) if len(y) else np.zeros(0, bool)
    ok = np.flatnonzero((right >= precision) & last)
    return round(float(scores[order][ok[-1]]) - 1e-6, 6) if len(ok) else float(np.max(scores, initial=0.0)) + 1.0


def _found(text: Column, kind: str) -> Column:
    """struct<base, rest> of a kind: base spans and the other candidates."""
    return let(
        spans_of(text, BASE[kind]),
        lambda m: let(F.filter(m, lambda x: passes(kind, x.v)), lambda base: F.struct(base.alias("base"), candidates(text, kind, m).alias("rest"))),
    )


@lru_cache(maxsize=4)
def _fit(app: str, seed: int, precision: float) -> dict:
    spark = SparkSession.active()
    texts = training_texts(seed)
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"i": i, "t": t[0]} for i, t in enumerate(texts)])), "array<struct<i:int,t:string>>")).alias("r")).select("r.i", "r.t")
    models = {}
    parts = [rows.select("i", _found(F.col("t"), kind).alias("k")).select(F.lit(kind).alias("kind"), "i", F.explode("k.rest").alias("c")) for kind in KINDS]
    every = reduce(DataFrame.unionByName, (x.select("kind", "i", "c.s", "c.e", features(F.col("c")).alias("f")) for x in parts)).collect()  # one job for all kinds
    for kind in KINDS:
        got = [r for r in every if r.kind == kind]
        x = np.array([r.f for r in got], float).reshape(-1, len(FEATURES))
        y = np.array([texts[r.i][3] == kind and r.e > texts[r.i][1] and r.s < texts[r.i][2] and r.e - r.s > 0.6 * (texts[r.i][2] - texts[r.i][1]) for r in got], float)
        fit = np.array([r.i % 3 != 0 for r in got], bool)
        model = boost(x[fit], y[fit])
        models[kind] = (model, threshold_for(tree_scores(model, x[~fit]), y[~fit], precision))
    return models


def fitted(spark: SparkSession, seed: int = 13, precision: float = 0.99) -> dict:
    """Per kind, the trees and the threshold, calibrated on a third of the training texts to the precision asked for."""
    return _fit(spark.sparkContext.applicationId, seed, precision)


_BLOCK = 128  # candidates that are looked at in one fold


def _choose(rest: Column, model: tuple[float, list], least: float) -> Column:
    """Of candidates that reach the threshold, the best first (score, then start, then end), each if it overlaps none taken before it.

    Candidates are cut into runs that overlap one another, directly or not, so one is compared with those of its run only.
    """
    kind = "struct<s:int,e:int,r:double,v:string>"
    scored = F.transform(rest, lambda c: let(features(c), lambda f: F.struct(c.s.alias("s"), c.e.alias("e"), (-as_column(model, f)).cast("double").alias("r"), c.v.alias("v"))))
    good = F.array_sort(F.array_distinct(F.filter(scored, lambda c: -c.r >= least)))

    def firsts(block: Column, end: Column) -> Column:
        """For each candidate of a block whether it starts a run, if those before the block reach to `end`. Blocks are short, so the lists that grow here are, too."""
        start = F.struct(end.alias("end"), F.array().cast("array<boolean>").alias("new"))
        return F.aggregate(block, start, lambda a, c: F.struct(F.greatest(a.end, c.e).alias("end"), F.concat(a.new, F.array(c.s >= a.end)).alias("new")), lambda a: a.new)

    def runs_of(g: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(g) - 1, F.lit(_BLOCK)), lambda i: F.slice(g, i + 1, F.lit(_BLOCK)))
        reach = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.array_max(F.transform(b, lambda c: c.e))))))
        new = let(blocks, lambda bs: let(reach(bs), lambda r: F.flatten(F.transform(bs, lambda b, i: firsts(b, F.get(r, i))))))
        begins = let(new, lambda n: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.get(n, i)))
        return let(begins, lambda at: F.transform(at, lambda i, k: F.slice(g, i + 1, F.coalesce(F.get(at, k + 1), F.size(g)) - i)))

    def greedy(group: Column) -> Column:
        ranked = F.transform(F.array_sort(F.transform(group, lambda c: F.struct(c.r.alias("r"), c.s.alias("s"), c.e.alias("e"), c.v.alias("v")))), lambda c: F.struct(c.s.alias("s"), c.e.alias("e"), c.r.alias("r"), c.v.alias("v")))
        taken = F.aggregate(ranked, F.array().cast(f"array<{kind}>"), lambda a, c: F.when(F.exists(a, lambda o: (o.s < c.e) & (c.s < o.e)), a).otherwise(F.concat(a, F.array(c))))
        return F.when(F.size(group) < 2, group).otherwise(F.array_sort(taken))

    runs = let(good, lambda g: F.when(F.size(g) > 0, runs_of(g)).otherwise(F.array().cast(f"array<array<{kind}>>")))
    return F.transform(F.flatten(F.transform(runs, greedy)), lambda c: F.struct(c.s.alias("s"), c.e.alias("e"), c.v.alias("v")))


def find(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, and per kind <kind>_base and <kind>_added: array<struct<s, e, v>> in code points, end exclusive, by start.

    A null text is an empty one. Base spans of a kind never overlap, added ones overlap neither them nor each other; spans of
    different kinds may. One row per row of docs: repeated rows give equal spans; an empty table gives an empty result.
    Other columns are not read.
    """
    models = fitted(docs.sparkSession)
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    likely = {"email": r"(?i)@|[\[({<]at[\])}>]| dot ", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]|\[\.\]|[0-9] ?\. ?[0-9]", "card": "[0-9]", "phone": "[0-9]"}
    for kind in KINDS:
        # no generator of a kind matches a text without these signs
        none = F.array().cast(f"array<struct<{_SPAN}>>")
        both = F.when(F.col("__text").rlike(likely[kind]), _found(F.col("__text"), kind)).otherwise(F.struct(none.alias("base"), none.alias("rest")))
        out = out.withColumn(f"__{kind}", both)
    cols = []
    for kind in KINDS:
        rest = F.col(f"__{kind}.rest")
        added = F.when(F.size(rest) == 0, F.array().cast("array<struct<s:int,e:int,v:string>>")).otherwise(_choose(rest, *models[kind]))
        cols += [F.transform(f"__{kind}.base", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.v.alias("v"))).alias(f"{kind}_base"), added.alias(f"{kind}_added")]
    return out.select(*keep, *cols)


def _named(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x.s.cast("string"), x.e.cast("string"))


def _tagged(kind: str):
    return lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(kind).alias("k"))


def span_list(found: DataFrame, added: bool) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""
    parts = []
    for kind in KINDS:
        own = F.array_sort(F.concat(f"{kind}_base", f"{kind}_added")) if added else F.col(f"{kind}_base")
        parts.append(F.transform(own, _named(kind)))
    return F.array_join(F.concat(*parts), ",")


def redact(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and redacted: the text with every span replaced by its kind in angle brackets; of overlapping spans of two kinds, the first one."""
    found = find(docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("__body")), text="__body", keep=(doc_id, "__body"))
    every = F.concat(*(F.transform(F.concat(f"{k}_base", f"{k}_added"), _tagged(k)) for k in KINDS))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.when(x.s < a.at, a).otherwise(F.struct(x.e.alias("at"), F.concat(a.out, F.substring("__body", a.at + 1, x.s - a.at), F.lit("<"), x.k, F.lit(">")).alias("out")))
    done = F.aggregate(F.array_sort(every), empty, step)
    return found.select(doc_id, let(done, lambda a: F.concat(a.out, F.substring("__body", a.at + 1, F.length("__body")))).alias("redacted"))
