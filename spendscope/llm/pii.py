"""Personal data: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.texts import fixed
from spendscope.session import settle

KINDS = ("email", "ip", "card", "phone", "secret", "national_id", "iban")  # the last three have no base pattern
CONTEXT = 40  # characters before a span that the context labeler reads
ROUNDS = 60  # of expectation and maximisation
STEPS = 300  # of the classifier's ascent
ACCEPT = 0.5
LEANING = 200.0  # candidates that what all kinds say of a labeler is worth for one of them

# The base patterns, so written that each position of a text is read a bounded number of times: a run is
# entered at its start only (or where the last match ended) and nothing is given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9A-Fa-f:.])(?=[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2})(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Fa-f:.])",
    # a run of key characters with a digit, and what stands after a word for a password
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
    r"|(?<![A-Za-z])(?i:password|passwd|passphrase|passwort|kennwort|contrase\x{00F1}a|mot\x20de\x20passe)\x20?[:=]\x20?[^\x20\x09-\x0D]{4,}+",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
NEEDS = {"email": "@", "phone": "+"}  # a text without it has no base match
LOOSE_NEEDS = {"email": "at", "ip": ":", "national_id": "-"}  # the others have no one sign that they need

# What the labelers know; words of context in English, German, French and Spanish.
SHAPES = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": r"^(?:(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}|(?=.*::|(?:[^:]+:){7})[0-9A-Fa-f:]+)$",
    "card": r"^(?:[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|3[47][0-9]{13}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20-]?)?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}$",
    # digests, tokens with known beginnings, and passwords by name
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|AKIA[0-9A-Z]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{36,}|glpat-.{20,}|(?:sk|pk|rk)[-_].{16,}|xox[abprs]-.{10,}|eyJ[A-Za-z0-9_-]{17,}|.*[:=][^:=]*[^A-Za-z].*)$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4})+(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})$",
}
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0\.|127\.|169\.254\.|22[4-9]\.|2[3-5][0-9]\.|::1$|(?i:fe80))",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|3[0-9]|4[0-9])|\(?[2-9])",
    # as varied as what is made by chance: a long digest, or digits with letters of both cases
    "secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).{20,}"
    r"|(?:AKIA|gh[pousr]_|glpat-|xox[abprs]-|eyJ|[spr]k[-_]).*|(?i:pass|kenn|contra|mot).*)$",
    "national_id": r"^(?!123-45-6789|078-05-1120|219-09-9999)",
    "iban": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)",
}
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach|kontakt|schreiben|courriel|correo|escribe|contacto)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from|login|adresse|serveur|servidor|rechner)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|pay|payment|karte|kreditkarte|carte|paiement|tarjeta|pago)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|contact|telefon|anrufen|handy|t\x{00E9}l\x{00E9}phone|appelez|tel\x{00E9}fono|llame|m\x{00F3}vil)\b",
    "secret": r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|private[_-]?key|bearer|auth|credential|schl\x{00FC}ssel|cl\x{00E9}|jeton|clave)[\x22'\x60]?\x20?(?:[:=]|is|ist|est|es)?\x20?[\x22'\x60]?$",
    "national_id": r"(?i)\b(?:ssn|social security|security number|tax id|taxpayer)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|banque|cuenta|banco)\b",
}
AGAINST = r"(?i)\b(?:version|section|chapter|isbn|order|invoice|part|build|release|commit|sha1|sha256|md5|checksum|digest)\b"

CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,shape:int,listed:int,context:int,size:int>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(k % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, k: a + worth(k)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern is one."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda part: F.coalesce(part.try_cast("int"), F.lit(256)) > 255)
    size = F.length(_digits(value))
    if kind == "phone":
        return size.between(8, 15)
    return F.when(size.between(16, 19), _luhn(_digits(value))).otherwise(F.lit(False))


def _spans(rows: DataFrame, name: str, pattern: str, needs: str | None) -> DataFrame:
    """Add ``name``: all matches of ``pattern`` with ``s, e`` (code points), value ``v`` and text before ``b``.

    Places follow from the lengths of the matches and of what lies between them.
    """
    none = F.expr("cast(array() as array<string>)")
    matches = F.regexp_extract_all("_text", F.lit(pattern), 0)
    rows = rows.withColumn("_m", fixed(F.when(F.contains("_text", F.lit(needs)), matches).otherwise(none) if needs else matches))
    rows = rows.withColumn("_p", fixed(F.when(F.size("_m") > 0, F.split("_text", pattern, -1)).otherwise(none)))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,v:string,b:string>>)").alias("out"))

    def add(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v"), F.substring(x["p"], -CONTEXT, CONTEXT).alias("b"))
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    paired = F.transform("_m", lambda m, i: F.struct(m.alias("m"), F.get("_p", i).alias("p")))
    return rows.withColumn(name, fixed(F.aggregate(paired, start, add, lambda a: a["out"]))).drop("_m", "_p")


def _voted(kind: str, found: Column, base: bool) -> Column:
    def shaped(value: Column) -> Column:
        fits = value.rlike(SHAPES[kind])
        return F.when(fits, _luhn(_digits(value))).otherwise(F.lit(False)) if kind == "card" else fits

    def vote(x: Column) -> Column:
        context = F.when(x["b"].rlike(FOR[kind]), 1).when(x["b"].rlike(AGAINST), -1).otherwise(0)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            x["s"].alias("start"),
            x["e"].alias("end"),
            (_holds(kind, x["v"]) if base else F.lit(False)).alias("base"),
            shaped(x["v"]).cast("int").alias("shape"),
            x["v"].rlike(GAZETTEER[kind]).cast("int").alias("listed"),
            context.alias("context"),
            F.least(F.length(x["v"]) / 8, F.lit(3)).cast("int").alias("size"),
        )

    return F.transform(found, vote)


def candidates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, found``: every match of a pattern with its votes."""
    rows = docs.select("doc_id", fixed(F.coalesce(F.col("text"), F.lit(""))).alias("_text"))
    names, voted = [], []
    for label, patterns, needs in (("_base", BASE, NEEDS), ("_loose", LOOSE, LOOSE_NEEDS)):
        for kind, pattern in patterns.items():
            rows = _spans(rows, f"{label}_{kind}", pattern, needs.get(kind))
            names.append(f"{label}_{kind}")
            voted.append(_voted(kind, F.col(names[-1]), label == "_base"))
    return rows.select("doc_id", F.concat(*voted).cast(CANDIDATE).alias("found"))


Cell = tuple[int, int, int, int, int]  # kind, shape, listed, context, size


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers (probability of each vote by truth) and the classifier's weights."""

    reliabilities: dict[str, dict[int, tuple[float, float]]]
    weights: tuple[float, ...]


def _features(cell: Cell) -> list[float]:
    kind, shape, listed, context, size = cell
    own = [1.0, float(shape), float(listed), float(context == 1), float(context == -1)]
    return own + [float(kind == k) for k in range(len(KINDS))] + [float(size == k) for k in range(4)]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _by_truth(weighted) -> tuple[float, float]:
    """How much weight is no personal data and how much is, of pairs of a count and a probability."""
    pairs = list(weighted)
    return sum(n * (1 - p) for n, p in pairs), sum(n * p for n, p in pairs)


def fit_spans(counts: dict[Cell, int]) -> SpanModel:
    """Estimate from how often each pattern of votes occurs; there are some 300 patterns at most.

    Expectation: the probability of each pattern to be personal data under the labelers' reliabilities;
    maximisation: the reliabilities and each kind's share under these probabilities. They then are the
    targets of a logistic regression on votes, kind and size.
    """
    labelers = {"shape": (1, (0, 1)), "listed": (2, (0, 1)), "context": (3, (-1, 0, 1))}
    truth = {c: min(0.95, max(0.05, 0.1 + 0.3 * c[1] + 0.3 * c[2] + 0.3 * c[3])) for c in counts}
    reliabilities: dict[str, dict[int, tuple[float, float]]] = {}
    for _ in range(ROUNDS if counts else 0):
        shares = {}
        for kind in range(len(KINDS)):
            own = [(n, truth[c]) for c, n in counts.items() if c[0] == kind]
            shares[kind] = (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))
        for name, (at, votes) in labelers.items():
            whole = _by_truth((n, truth[c]) for c, n in counts.items())
            general = {v: _by_truth((n, truth[c]) for c, n in counts.items() if c[at] == v) for v in votes}
            for kind, label in enumerate(KINDS):
                own = {v: _by_truth((n, truth[c]) for c, n in counts.items() if c[0] == kind and c[at] == v) for v in votes}
                totals = [sum(own[v][y] for v in votes) for y in (0, 1)]
                # a kind that is seldom seen leans on what the labeler is worth elsewhere
                prior = {v: [(1 + general[v][y]) / (len(votes) + whole[y]) for y in (0, 1)] for v in votes}
                reliabilities[f"{name}/{label}"] = {
                    v: tuple((own[v][y] + LEANING * prior[v][y]) / (totals[y] + LEANING) for y in (0, 1)) for v in votes
                }
        for c in counts:
            odds = math.log(shares[c[0]] / (1 - shares[c[0]]))
            for name, (at, _) in labelers.items():
                no, yes = reliabilities[f"{name}/{KINDS[c[0]]}"][c[at]]
                odds += math.log(yes / no)
            truth[c] = _sigmoid(odds)
    rows = [(_features(c), n, truth[c]) for c, n in sorted(counts.items())]
    total = sum(n for _, n, _ in rows) or 1
    weights = [0.0] * len(_features((0, 0, 0, 0, 0)))
    for _ in range(STEPS if rows else 0):
        slope = [0.0] * len(weights)
        for x, n, p in rows:
            error = n / total * (p - _sigmoid(sum(w * v for w, v in zip(weights, x))))
            slope = [s + error * v for s, v in zip(slope, x)]
        weights = [w + 2.0 * (s - 1e-4 * w) for w, s in zip(weights, slope)]
    return SpanModel(reliabilities, tuple(weights))


def _score(model: SpanModel, c: Column) -> Column:
    w = model.weights
    sums = F.lit(w[0]) + w[1] * c["shape"] + w[2] * c["listed"] + F.when(c["context"] == 1, w[3]).when(c["context"] == -1, w[4]).otherwise(0.0)
    kind = F.element_at(F.array(*map(F.lit, w[5 : 5 + len(KINDS)])), c["kind"] + 1)
    return sums + kind + F.element_at(F.array(*map(F.lit, w[5 + len(KINDS) :])), c["size"] + 1)


def _outdoes(one: Column, other: Column) -> Column:
    def rank(c: Column) -> Column:
        return F.struct((c["end"] - c["start"]).alias("size"), (-c["start"]).alias("start"), (-c["kind"]).alias("kind"))

    return rank(one) > rank(other)


def find_personal_data(docs: DataFrame) -> tuple[DataFrame, SpanModel]:
    """Per row of ``docs``: ``doc_id, base, spans`` (arrays of ``kind, start, end``, by kind and start), and the model.

    ``base`` are the matches of the base patterns that hold; ``spans`` are these and the other candidates
    - matches that fail, obfuscated addresses, national numbers, keys and passwords, identity and account
    numbers - that the classifier accepts and that touch no base span nor a longer one of these. Null and empty texts have none; repeated rows each get their own result. The text
    is read once, in its row; what leaves the tasks for the driver is a count per pattern of votes.
    """
    found = settle(candidates(docs), "candidates")
    cells = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.shape", "c.listed", "c.context", "c.size").count()
    model = fit_spans({tuple(r[:5]): r[5] for r in cells.collect()})

    def place(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))

    limit = math.log(ACCEPT / (1 - ACCEPT))
    rows = found.withColumn("base", fixed(F.sort_array(F.transform(F.filter("found", lambda c: c["base"]), place))))
    more = F.filter(
        "found",
        lambda c: ~c["base"]
        & (_score(model, c) >= limit)
        & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    rows = rows.withColumn("_more", fixed(F.array_distinct(F.transform(more, place))))
    # of added spans that overlap, the longest stays, then the first, then the first kind
    more = F.filter("_more", lambda c: ~F.exists("_more", lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & _outdoes(o, c)))
    spans = F.sort_array(F.array_distinct(F.concat("base", more)))
    return rows.select("doc_id", "base", spans.alias("spans")), model


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
