"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Labelers vote on each of them: its form, a gazetteer, the words before it and the characters around it. Expectation-maximisation
over the counted vote patterns estimates how reliable each labeler is, and the posteriors train a final logistic classifier of spans. Spans of the four base kinds always
stay; the classifier decides on the others. Counts of vote patterns and features are bounded by their number of values, whatever the input's size.

A labeler votes once on each candidate; what later steps need of a candidate is its kind, place, votes and features, and only these are written. Among candidates of unlike kinds that overlap, each
stands for itself: spans of one kind don't overlap, spans of several may.

Spans count code points, the end is exclusive. A null text counts as empty; a null doc_id stays null; every row gives a row, repeated ones too; very long texts count whole; only the id and the text
are read, so other columns can have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolign.llm.common import id_and_text, staged

# Fixed values of the base kinds, with starts only where a match can start and without needless backtracking.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Given names and surnames that are frequent in English, German, French and Spanish.
GIVEN = """Adam Alain Albert Alejandro Alexander Alice Ana Andreas Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Bernd Camille Carlos Carmen Catherine Charles Charlotte Christian Christine
Christopher Claire Claudia Daniel David Diego Donald Elena Elizabeth Emily Emma Eric Eva Felix Fernando Francisco François Frank Franz George Hannah Hans Heike Helen Henry Hugo Ines Isabel Isabelle Jack
Jacques James Jan Javier Jean Jennifer Jessica Joachim John Jonas José Joseph Juan Julia Julie Jürgen Karl Katharina Klaus Laura Lena Linda Lisa Louis Lucas Lucía Luis Lukas Manuel Marc Margaret María Maria
Marie Mark Markus Martina Mary Max Michael Miguel Monika Nathalie Nicolas Nicole Olivia Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Pilar Rafael Raúl Richard Robert Rosa Sabine Sandra Sarah Sebastian
Sofia Sophie Stefan Stephanie Susan Thomas Ursula Uwe Véronique Werner William Wolfgang""".split()
SURNAMES = """Álvarez André Bauer Becker Bernard Blanc Bonnet Brown Clark Davis Díaz Dubois Durand Evans Fernández Fischer Fournier Garcia García Girard Gómez González Green Hall Harris Hernández Hoffmann Jackson
Johnson Jones Keller King Klein Koch Krause Lambert Lefebvre Leroy Lewis López Martin Martínez Mercier Meyer Miller Moore Moreau Moreno Morel Müller Muñoz Neumann Pérez Petit Ramírez Richter Robinson Rodríguez
Romero Rousseau Roux Ruiz Sánchez Schäfer Schmidt Schmitt Schneider Scott Simon Smith Taylor Thompson Torres Vincent Wagner Walker Weber White Williams Wilson Wolf Wright Young Zimmermann""".split()
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra?)\.?"
_NAME = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?"
ADDED = {
    "obfuscated": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?<![\p{{L}}])(?=\p{{Lu}})(?:{_TITLE} {_NAME}(?: {_NAME})?|(?:{'|'.join(GIVEN)}) {_NAME})(?!\p{{L}})",
}
#: What a text must hold for a pattern to match, as a quick test.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "obfuscated": r"[(\[]at[)\]]", "iban": "[A-Z]{2}[0-9]{2}", "person": r"\p{L}\.? \p{Lu}\p{Ll}"}
KINDS = (*BASE, *ADDED)

# Gazetteers and cues, in the four languages of the corpus.
_PROVIDERS = "gmail|googlemail|yahoo|ymail|hotmail|outlook|live|msn|icloud|aol|proton|protonmail|fastmail|zoho|gmx|web|t-online|freenet|posteo|mailbox|orange|wanadoo|free|laposte|sfr|telefonica|movistar|example|mail"
GAZETTEER = {
    "email": rf"(?i)@(?:.*\.)?(?:{_PROVIDERS})[0-9]*\.",
    "ip": r"^(?!0|127|255)[0-9]",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "obfuscated": rf"(?i)(?:{_PROVIDERS})",
    "iban": "^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR)",
    "person": rf"(?<!\p{{L}})(?:{'|'.join(GIVEN + SURNAMES)})(?!\p{{L}})",
}
CUES = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel|write|reach)\W*$",
    "ip": r"(?i)(?:ip|host|server|address|adresse|from|client)\W*$",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|master|account|konto|compte)\W*$",
    "phone": r"(?i)(?:tel|phone|call|mobil|fax|fon|téléphone|teléfono)\W*$",
    "obfuscated": r"(?i)(?:mail|contact|kontakt|correo|courriel|write|reach|escribe|schreib\w*)\W*(?:to|at|an|à|a)?\W*$",
    "iban": r"(?i)(?:iban|konto|account|compte|cuenta|bank|transfer|überweis\w*|virement)\W*(?:to|auf|sur|a)?\W*$",
    "person": r"(?i)(?:\b(?:by|from|with|name|named|von|mit|par|avec|de|con|dear|liebe[r]?|cher|chère|signed|is|ist|est|es|and|und|et|y)|[.,:;!?])\W*$",
}
AGAINST = r"(?i)(?:version|isbn|order|build|chapter|figure|table|page|doi|serial|sku|code|part|model|ship|street|avenue|rue|calle)\W*(?:no|nr|number|id)?\W*$"
LABELERS = ("form", "gazetteer", "context", "edges")
FEATURES = ("long", "spaced", "digits")


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once however often `of` uses it, within its lambdas too."""
    return F.element_at(F.transform(F.array(value), of), 1)


def running_sums(steps: Column, block: int = 256) -> Column:
    """Inclusive running sums of an integer array, by blocks, so that the work stays in proportion to the array."""

    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("int").alias("s"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(part, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")), lambda acc: acc["a"])

    def of(steps: Column) -> Column:
        return bound(F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: sums(F.slice(steps, b * block + 1, F.lit(block)))), joined)

    def joined(blocks: Column) -> Column:
        before = sums(F.concat(F.array(F.lit(0)), F.transform(blocks, lambda a: F.element_at(a, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda a, s: F.transform(a, lambda x: x + s)))

    return bound(steps, lambda s: F.when(F.size(s) > 0, of(s)).otherwise(F.array().cast("array<int>")))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def iban_holds(match: Column) -> Column:
    """Whether the remainder by 97 is 1, with the first four characters behind the others and letters as two digits."""
    plain = F.regexp_replace(match, " ", "")

    def add(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, total * 10 + (code - 48)).otherwise(total * 100 + (code - 55)) % 97

    return F.aggregate(F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), ""), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(add(t, c))) == 1


def holds(kind: str, match: Column) -> Column:
    """Whether a match of a base kind counts."""
    number = digits(match)
    if kind == "ip":
        return match.rlike(r"^(?:0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(number).between(8, 15)
    return F.lit(True)


def matches(kind: str, pattern: str) -> Column:
    """Array of struct kind, match, start, end, left, right of a pattern's matches in `text`: those that leftmost search finds one after the other."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    return F.when(F.col("text").rlike(NEEDS[kind]), F.struct(found.alias("found"), gaps.alias("gaps"))).alias(kind)


def placed(kind: str) -> Column:
    found, gaps = F.col(kind)["found"], F.col(kind)["gaps"]
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))), lambda g, m: F.length(g) + F.length(m))
    made = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("l"), F.slice(gaps, F.lit(2), F.size(found)).alias("r"), running_sums(steps).alias("s")),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["m"].alias("match"), x["s"].cast("long").alias("start"), (x["s"] + F.length(x["m"])).cast("long").alias("end"), F.substring(x["l"], -24, 24).alias("left"), F.substring(x["r"], 1, 4).alias("right")),
    )
    kept = F.filter(made, lambda x: holds(kind, x["match"]))
    return F.when(F.col(kind).isNotNull() & (F.size(found) > 0), kept).otherwise(F.array().cast(f"array<{_SPAN}>"))


_SPAN = "struct<kind:string,match:string,start:bigint,end:bigint,left:string,right:string>"


def votes(x: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1 for personal data, -1 against, 0 for none."""
    of = lambda table: F.coalesce(*[F.when(x["kind"] == k, x["left" if table is CUES else "match"].rlike(p)) for k, p in table.items()], F.lit(False))
    number = digits(x["match"])
    odd = (F.length(number) >= 8) & number.rlike(r"^(.)\1*$|0{6}|123456789")
    return {
        "form": F.when(odd, -1).when(x["kind"].isin(*BASE), 1).when(x["kind"] == "iban", F.when(iban_holds(x["match"]), 1).otherwise(-1))
        .when(x["kind"] == "obfuscated", F.when(x["match"].rlike(r"[A-Za-z]{2,6}$"), 1).otherwise(-1)).when(x["match"].rlike(f"^{_TITLE} "), 1).otherwise(0),
        "gazetteer": F.when(of(GAZETTEER), 1).otherwise(0),
        "context": F.when(x["left"].rlike(AGAINST), -1).when(of(CUES), 1).otherwise(0),
        "edges": F.when(x["left"].rlike(r"[\p{L}0-9]$") | x["right"].rlike(r"^[\p{L}0-9]"), -1).otherwise(1),
    }


def features(x: Column) -> dict[str, Column]:
    match = x["match"]
    return {"long": (F.length(match) >= 16).cast("int"), "spaced": match.contains(" ").cast("int"), "digits": (F.length(digits(match)) * 2 >= F.length(match)).cast("int")}


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of struct kind, start, end, votes and features) of every row."""
    texts = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    found = texts.select("doc_id", *[matches(k, p) for k, p in (BASE | ADDED).items()])
    judged = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *[v.cast("int").alias(k) for k, v in (votes(x) | features(x)).items()])
    return found.select("doc_id", F.transform(F.concat(*[placed(k) for k in KINDS]), judged).alias("spans"))


def reliabilities(cells: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, dict]:
    """EM over (kind, votes, count): for each labeler the chance of each vote given truth, and for each kind the share of true spans. Smoothed and begun with the belief that labelers are right more often than not."""
    n = len(LABELERS)
    chance = [{t: {v: 0.6 if v == (1 if t else -1) else 0.2 for v in (-1, 0, 1)} for t in (0, 1)} for _ in range(n)]
    share = {k: 0.7 for k, _, _ in cells}
    for _ in range(rounds):
        sums = [{t: {v: 3.0 if v == (1 if t else -1) else 1.0 for v in (-1, 0, 1)} for t in (0, 1)} for _ in range(n)]
        kinds = {k: [7.0, 10.0] for k in share}
        for kind, vote, count in cells:
            p = posterior(vote, share[kind], chance)
            kinds[kind][0] += p * count
            kinds[kind][1] += count
            for j, v in enumerate(vote):
                sums[j][1][v] += p * count
                sums[j][0][v] += (1 - p) * count
        chance = [{t: {v: c / sum(s[t].values()) for v, c in s[t].items()} for t in (0, 1)} for s in sums]
        share = {k: a / b for k, (a, b) in kinds.items()}
    return share, chance


def posterior(vote: tuple[int, ...], share: float, chance: list) -> float:
    yes, no = share, 1 - share
    for j, v in enumerate(vote):
        yes, no = yes * chance[j][1][v], no * chance[j][0][v]
    return yes / (yes + no)


def fit(rows: list[tuple[list[float], float, int]], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic regression on (features, soft label, count) by gradient descent."""
    weights = [0.0] * (len(rows[0][0]) if rows else 1)
    total = sum(c for _, _, c in rows) or 1
    for _ in range(rounds):
        slope = [0.001 * w for w in weights]
        for x, y, count in rows:
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True)))))) - y) * count / total
            for j, value in enumerate(x):
                slope[j] += error * value
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, spans (array of struct kind, start, end, score): base spans all, added ones that the classifier gives `threshold` or more; by kind, then start."""
    held = staged(candidates(docs), "pii-candidates")
    each = held.select(F.explode("spans").alias("x")).select("x.*")
    # At most (kinds x 3 ** labelers x 2 ** features) rows.
    cells = [(r["kind"], tuple(r[k] for k in LABELERS), tuple(r[k] for k in FEATURES), r["count"]) for r in each.groupBy("kind", *LABELERS, *FEATURES).count().orderBy("kind", *LABELERS, *FEATURES).collect()]
    share, chance = reliabilities([(k, v, c) for k, v, _, c in cells])
    inputs = lambda k, v, f: [1.0, *[float(k == x) for x in KINDS], *map(float, v), *map(float, f)]
    weights = fit([(inputs(k, v, f), posterior(v, share[k], chance), c) for k, v, f, c in cells]) if cells else [0.0] * (1 + len(KINDS) + len(LABELERS) + len(FEATURES))

    def score(x: Column) -> Column:
        own = [*[(x["kind"] == k).cast("double") for k in KINDS], *[x[k].cast("double") for k in (*LABELERS, *FEATURES)]]
        return 1 / (1 + F.exp(-sum((c * w for c, w in zip(own, weights[1:], strict=True)), F.lit(weights[0]))))

    scored = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))
    return held.select("doc_id", F.filter(scored, lambda x: x["kind"].isin(*BASE) | (x["score"] >= threshold)).alias("spans"))
