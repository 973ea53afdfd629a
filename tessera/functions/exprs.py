"""Scalar functions on symbols, predicates, labels and scores, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mark a container rather than a thing.
CONTAINER_TOKENS = ["system", "mechanism", "device", "entity", "object", "thing", "relationship", "process", "event", "information", "data", "component"]
# Expected types that stand for a person.
PERSON_WORDS = ["person", "people", "man", "woman", "boy", "girl"]
#: Predicates that place a thing.
LOCATION_FAMILY = ["locationTransfer", "containment", "locatedIn", "inside", "in", "at"]


def strip_namespace(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"^(entity|concept):", "")


def is_iri(symbol: Column) -> Column:
    return symbol.rlike(r"^https?://")


def local_name(predicate: Column) -> Column:
    """After the last # or /, lower-cased."""
    return F.lower(F.regexp_extract(predicate, r"[^#/]*$", 0))


def display(symbol: Column) -> Column:
    return F.replace(strip_namespace(symbol), F.lit("_"), F.lit(" "))


def normal_search(label: Column) -> Column:
    """Search form of a label: lower case, underscores to blanks, runs of blanks squeezed."""
    return F.regexp_replace(F.replace(F.lower(F.trim(label)), F.lit("_"), F.lit(" ")), r"\s+", " ")


def normal_token(label: Column) -> Column:
    """Token form: runs of other than a-z0-9 to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def normal_mapper(label: Column) -> Column:
    """Mapper form: other than a-z0-9_ and blanks dropped, runs of blanks to an underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[^a-z0-9_ ]", ""), r"\s+", "_")


def tokens(symbol: Column) -> Column:
    return F.filter(F.split(F.lower(strip_namespace(symbol)), r"[_\s]+"), lambda t: t != "")


def has_loss(symbol: Column) -> Column:
    return F.exists(tokens(symbol), lambda t: t.startswith("loss"))


def specificity(symbol: Column) -> Column:
    """1.0 for entities and 0.5 for concepts, up to 0.4 for tokens, less for containers and losses."""
    base = F.when(symbol.startswith("concept:"), 0.5).otherwise(1.0)

    def rated(own: Column) -> Column:
        containers = F.size(F.filter(own, lambda t: t.isin(CONTAINER_TOKENS)))
        losses = F.size(F.filter(own, lambda t: t.startswith("loss")))
        return base + F.least(F.lit(0.4), 0.05 * F.size(own)) - 0.35 * containers - 0.3 * losses

    # The tokens are made once and not for each of their three uses.
    return F.get(F.transform(F.array(tokens(symbol)), rated), F.lit(0))


def boolean_concept(symbol: Column) -> Column:
    bare = F.lower(strip_namespace(symbol))
    return F.when(bare == "true", True).when(bare == "false", False)


def singular(word: Column) -> Column:
    return F.when(word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def plural(word: Column) -> Column:
    return F.when(word.endswith("s"), word).otherwise(F.concat(word, F.lit("s")))


def verb_stem(word: Column) -> Column:
    w = F.lower(word)
    drop = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(w == "failure", "fail")
        .when(w.endswith("ied") & (F.length(w) > 4), F.concat(drop(3), F.lit("y")))
        .when(w.endswith("ing") & (F.length(w) > 5), drop(3))
        .when(w.endswith("ed") & (F.length(w) > 4), drop(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), drop(1))
        .otherwise(w)
    )


def strip_enumeration(line: Column) -> Column:
    """Without a leading `7. `, `7) ` or `7: `."""
    return F.regexp_replace(line, r"^\s*\d+[.):]\s+", "")


def triple_text(text: Column) -> Column:
    """First three words of a text as a triple, null if there are fewer."""
    parts = F.split(F.trim(text), r"\s+")
    return F.when(F.size(parts) >= 3, F.struct(parts[0].alias("s"), parts[1].alias("p"), parts[2].alias("o")))


def mean_score(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    mean = total / F.lit(float(len(parts)))
    return F.when(mean > 1.0, 1.0).otherwise(mean)  # null if a part is null


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def memory_focus(subject_active: Column, object_active: Column, answer_active: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(answer_active), 1.0).when(yes(subject_active), 0.9).when(yes(object_active), 0.8).otherwise(0.6)


def role_match(value: Column, role: str) -> Column:
    """An annotation value lists roles between commas, semicolons or bars."""
    return F.exists(F.split(F.coalesce(value, F.lit("")), r"[,;|]"), lambda r: F.lower(F.trim(r)) == role)


def template_parts(template: Column) -> Column:
    """`verb:..;voice:passive;prep:..` as a map."""
    return F.str_to_map(template, F.lit(";"), F.lit(":"))


def trigram_slots(label: Column) -> Column:
    """(slot, sign) of each character trigram of a label, for 256 dimensions.

    The slot is the low byte of the trigram's 31-based hash; the sign its lowest bit.
    """
    text = normal_mapper(label)
    n = F.greatest(F.length(text) - 2, F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(3)))

    def hashed(gram: Column) -> Column:
        # a trigram is 961 a + 31 b + c; shorter texts are hashed whole the same way
        return F.aggregate(F.split(gram, ""), F.lit(0), lambda h, c: F.when(c == "", h).otherwise((31 * h + F.ascii(c)) % 256))

    return F.transform(grams, lambda g: F.struct(hashed(g).alias("slot"), F.when(hashed(g) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
