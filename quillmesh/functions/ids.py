"""Identifiers: normalising, building and parsing node ids, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space inside a site: what other engines' \s stands for, which has no vertical tab.
_BLANK = r"\t\n\f\r "
#: A phosphorylation site in free text: residue, then position; and in any case, the long s (ſ) being an s.
SITE_PATTERN = rf"(SER|THR|TYR|S|T|Y)[{_BLANK}\-]*([0-9]+)"
ANY_CASE_PATTERN = rf"(?i)([Sſ]ER|THR|TYR|[Sſ]|T|Y)[{_BLANK}\-]*([0-9]+)"
#: One gene and one site in a single token of a pathway file.
TOKEN_PATTERN = rf"(?i)^([A-Za-z0-9]+)[{_BLANK}:_\-]*(SER|THR|TYR|S|T|Y)[{_BLANK}:_\-]*([0-9]+)$"
#: A site label as measured tables write it, in capitals only.
LABEL_PATTERN = rf"([STY])[{_BLANK}]*([0-9]+)"


def normalize_protein(c: Column) -> Column:
    return F.upper(F.trim(c))


def normalize_site(c: Column) -> Column:
    """First site in the text as S/T/Y and position, else null. Letters whose capitals are two (ß, ﬅ, ﬆ) are no residues."""
    up = F.upper(F.translate(F.trim(c), "ßﬅﬆ", "ẞẞẞ"))
    position = F.regexp_extract(up, SITE_PATTERN, 2)
    return F.when(position != "", F.concat(F.left(F.regexp_extract(up, SITE_PATTERN, 1), F.lit(1)), position))


def protein_id(gene: Column) -> Column:
    return F.concat(F.lit("PROTEIN:"), gene)


def site_id(gene: Column, label: Column) -> Column:
    return F.concat(F.lit("SITE:"), gene, F.lit("-"), label)


def parse_site_node_id(c: Column) -> Column:
    """struct(gene, site_label), split at the last hyphen; null for anything else."""
    gene, label = (F.regexp_extract(c, r"^SITE:(.+)-([^-]+)$", i) for i in (1, 2))
    return F.when((gene != "") & (label != ""), F.struct(gene.alias("gene"), label.alias("site_label")))


def parse_site_token(c: Column) -> Column:
    """struct(gene, site_label) of a token such as AKT1-S473, AKT1_Ser473 or AKT1:S-473; null for others."""
    gene, residue, position = (F.regexp_extract(F.trim(c), TOKEN_PATTERN, i) for i in (1, 2, 3))
    label = F.concat(F.upper(F.left(residue, F.lit(1))), position)
    return F.when(position != "", F.struct(F.upper(gene).alias("gene"), label.alias("site_label")))


def single_site_label(c: Column) -> Column:
    """The label, if the text has exactly one (capitals only); else null."""
    label = F.concat(F.regexp_extract(c, LABEL_PATTERN, 1), F.regexp_extract(c, LABEL_PATTERN, 2))
    return F.when(F.regexp_count(c, F.lit(LABEL_PATTERN)) == 1, label)


def has_one_site(c: Column) -> Column:
    """Whether the text names exactly one site, in any case; false for null."""
    return F.coalesce(F.regexp_count(c, F.lit(ANY_CASE_PATTERN)) == 1, F.lit(False))


def has_no_separator(c: Column) -> Column:
    """Whether the text is one site by its separators: not blank, not 'nan', no ; , or /."""
    t = F.lower(F.trim(c))
    return F.coalesce((t != "") & (t != "nan") & ~t.rlike("[;,/]"), F.lit(False))


def normalize_site_token(c: Column) -> Column:
    """Three-letter residues to one letter, no spaces, capitals."""
    out = F.trim(c)
    for long, short in (("Ser", "S"), ("SER", "S"), ("Thr", "T"), ("THR", "T"), ("Tyr", "Y"), ("TYR", "Y")):
        out = F.replace(out, F.lit(long), F.lit(short))
    return F.upper(F.replace(out, F.lit(" "), F.lit("")))


def clean_node_id(c: Column) -> Column:
    """What follows the first colon, or all."""
    return F.element_at(F.split(c, ":", 2), -1)


def strip_prefix(c: Column, prefix: str = "PROTEIN:") -> Column:
    return F.replace(c, F.lit(prefix), F.lit(""))


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ids of an undirected edge in order."""
    return F.least(a, b), F.greatest(a, b)


def peptide_alias(c: Column) -> Column:
    """Id without its species prefix, if what follows the first dot starts with ENSP; else null."""
    rest = F.element_at(F.split(c, r"\.", 2), -1)
    return F.when(rest.startswith("ENSP"), rest)


def is_member(c: Column, joined: Column, sep: str = ";") -> Column:
    """Whether a value is in a joined list."""
    return F.coalesce(F.array_contains(F.split(joined, sep), c), F.lit(False))
