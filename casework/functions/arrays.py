"""Expressions over the nested lists of a case (movements, subjects).

Higher-order functions (``filter``, ``transform``, ``exists``) evaluate the
list inside the row: no explode, no shuffle, whole-stage codegen friendly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework import constants as K
from casework.functions import text as X
from casework.functions import time as TM


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def size0(c) -> Column:
    """List length, 0 for a missing list."""
    c = _col(c)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(c))


def is_decision_name(nome: Column) -> Column:
    """F1 term test on a movement name (case-sensitive substring)."""
    return F.coalesce(X.contains_any(nome, K.DECISION_TERMS), F.lit(False))


def decision_names(movements, grau=None) -> Column:
    """Names of the decision movements, in list order; when ``grau`` is
    given only first-instance hits have decisions (F1)."""
    names = F.transform(F.filter(_col(movements), lambda m: is_decision_name(m["nome"])),
                        lambda m: m["nome"])
    names = F.coalesce(names, F.array().cast("array<string>"))
    if grau is not None:
        names = F.when(_col(grau) == F.lit(K.FIRST_INSTANCE), names).otherwise(
            F.array().cast("array<string>"))
    return names


def subject_names(subjects) -> Column:
    """Subject objects -> names (a missing ``nome`` gives null)."""
    return F.transform(F.coalesce(_col(subjects), F.array().cast("array<struct<codigo:bigint,nome:string>>")),
                       lambda a: a["nome"])


def main_subject(subjects) -> Column:
    """Name of the first subject, default when there is none."""
    first = F.get(_col(subjects), 0)
    return F.when(first.isNull(), F.lit(K.DEFAULT_SUBJECT)).otherwise(
        F.coalesce(first["nome"], F.lit(K.DEFAULT_SUBJECT)))


def joined_lower_names(subjects) -> Column:
    """C4: lower-cased subject names joined with a space (missing name = '')."""
    return F.lower(F.array_join(F.transform(
        F.coalesce(_col(subjects), F.array().cast("array<struct<codigo:bigint,nome:string>>")),
        lambda a: F.coalesce(a["nome"], F.lit(""))), " "))


def first_timed_decision_hour(movements) -> Column:
    """M3: hour (in the text's own offset) of the first decision movement
    (any instance) whose time parses; null when there is none."""
    decisions = F.filter(_col(movements), lambda m: is_decision_name(m["nome"]))
    hours = F.transform(decisions, lambda m: TM.iso_hour(m["dataHora"]))
    return F.get(F.filter(hours, lambda h: h.isNotNull()), 0)


def subject_names_from_json(raw_json) -> Column:
    """P4 on raw JSON text of a subject list whose elements may not all be
    objects: each element is kept as its own JSON text, an object gives its
    ``nome`` (null when absent) and any other element gives ''. One bad
    element does not null the whole list (as a typed ``from_json`` would)."""
    elems = F.from_json(_col(raw_json), "array<string>")
    return F.transform(elems, lambda e: F.when(F.ltrim(e).startswith("{"),
                                               F.get_json_object(e, "$.nome")).otherwise(F.lit("")))
