"""Axioms as line text: one triple a line, read into the tables of an ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# IRIs of the W3C vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
KINDS = {f"{RDFS}subClassOf": "subclass", f"{RDFS}subPropertyOf": "subproperty", f"{RDFS}range": "range", f"{RDFS}label": "label", f"{OWL}inverseOf": "inverse"}
FLAGS = {f"{OWL}SymmetricProperty": "symmetric", f"{OWL}TransitiveProperty": "transitive"}

#: <subject> <predicate> and an <object> or a "literal", which may hold escapes and end in a language or type
LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*$'


def triples(lines: DataFrame) -> DataFrame:
    """(s, p, o, is_iri) of (value); comments, blank, null and malformed lines are no triples."""
    part = lambda i: F.regexp_extract("value", LINE, i)
    literal = F.regexp_replace(F.regexp_replace(part(4), r'\\"', '"'), r"\\\\", r"\\")
    return lines.filter(F.col("value").rlike(LINE)).select(part(1).alias("s"), part(2).alias("p"), F.when(part(3) != "", part(3)).otherwise(literal).alias("o"), (part(3) != "").alias("is_iri"))


def tables(rows: DataFrame) -> DataFrame:
    """(kind, s, p, o): each axiom once, by the kind of its predicate.

    A literal under another predicate is an annotation, an IRI there a target; a flag of a property has its
    name as the kind. Other types are targets.
    """
    chosen = lambda column, names: F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), column)
    kind = F.coalesce(
        chosen(F.col("p"), KINDS),
        F.when(F.col("p") == f"{RDF}type", chosen(F.col("o"), FLAGS)),
        F.when(F.col("is_iri"), "target").otherwise("annotation"),
    )
    return rows.select(kind.alias("kind"), "s", "p", "o").distinct()


def lines(rows: DataFrame) -> DataFrame:
    """(value): the line of each (s, p, o, is_iri)."""
    literal = F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"')
    end = F.when(F.col("is_iri"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), literal, F.lit('"')))
    return rows.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), end, F.lit(" .")).alias("value"))
