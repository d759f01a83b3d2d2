"""Model-ready feature table.

One projection per stage; the data-dependent one-hot width is fixed from a
bounded, distributed vocabulary aggregate (the only driver-side step).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework import constants as K
from casework.functions import arrays as A
from casework.functions import text as X
from casework.functions.rounding import round_binary
from casework.functions import time as TM
from casework.operators.sequence import with_sequence

TEMPORAL = ["dias_desde_ajuizamento", "ano_ajuizamento", "mes_ajuizamento", "eh_segunda", "eh_sexta"]
FEATURE_COLUMNS = [  # order of the feature row
    "numero_processo", *TEMPORAL, "municipio_fortaleza", "qtd_assuntos", "tem_tutela_urgencia",
    "tem_obrigacao_fazer", "tem_dano_moral", "assunto_principal", "qtd_movimentos",
    "velocidade_movimentos", "eh_horario_almoco", "complexidade_score", "tem_recurso",
]


def temporal_features(filed_text: Column, updated_text: Column) -> dict[str, Column]:
    """M1: all five are 0 when either date fails."""
    filed = TM.parse_compact(filed_text)
    updated = TM.parse_iso_naive(updated_text)
    ok = filed.isNotNull() & updated.isNotNull()
    wd = F.weekday(filed)

    def z(c):
        return F.when(ok, c).otherwise(F.lit(0)).cast("int")

    return {
        "dias_desde_ajuizamento": z(TM.days_between(filed, updated)),
        "ano_ajuizamento": z(F.year(filed)),
        "mes_ajuizamento": z(F.month(filed)),
        "eh_segunda": z(X.flag(wd == K.MONDAY)),
        "eh_sexta": z(X.flag(wd == K.FRIDAY)),
    }


def dates_ok(filed_text: Column, updated_text: Column) -> Column:
    """Whether both dates parse, which tells a real 0 from a failure."""
    return X.flag(TM.parse_compact(filed_text).isNotNull() & TM.parse_iso_naive(updated_text).isNotNull())


def subject_features(subjects: Column, accent_insensitive: bool = False) -> dict[str, Column]:
    """M2: count, keyword flags over the joined lower-cased names, main
    subject. The urgency words have no accents; ``accent_insensitive`` folds
    those of the names first, so ``Urgência`` counts too (N7)."""
    text = A.joined_lower_names(subjects)
    plain = lambda phrase: phrase
    if accent_insensitive:
        text = F.translate(text, X.ACCENTED, X.UNACCENTED)
        plain = lambda phrase: phrase.translate(str.maketrans(X.ACCENTED, X.UNACCENTED))
    has = lambda phrase: text.contains(plain(phrase))
    return {
        "qtd_assuntos": A.size0(subjects),
        "tem_tutela_urgencia": X.flag(has(K.URGENCY_WORDS[0]) & has(K.URGENCY_WORDS[1])),
        "tem_obrigacao_fazer": X.flag(has(K.OBLIGATION_PHRASE)),
        "tem_dano_moral": X.flag(has(K.MORAL_DAMAGE_PHRASE)),
        "assunto_principal": A.main_subject(subjects),
    }


def lunch_flag(movements: Column) -> Column:
    """M3: first timed decision falls in 11:00-13:59 (its own offset)."""
    h = A.first_timed_decision_hour(movements)
    return X.flag(h.between(K.LUNCH_FIRST_HOUR, K.LUNCH_LAST_HOUR))


def velocity(n_movements: Column, days: Column) -> Column:
    """C17/M4: movements per day, rounded to 4 places half to even by the binary
    value, 0 when the duration is not positive."""
    return F.when(days > 0, round_binary(n_movements / days, K.VELOCITY_DECIMALS)).otherwise(F.lit(0.0))


def case_features(cases: DataFrame, keep: list[str] | None = None, date_ok: bool = False,
                  accent_insensitive: bool = False) -> DataFrame:
    """M7: the feature row of every case (one projection, no shuffle).
    ``date_ok`` adds that column (N4); ``accent_insensitive`` as in
    :func:`subject_features`."""
    t = temporal_features(F.col("data_ajuizamento"), F.col("ultima_atualizacao"))
    s = subject_features(F.col("assuntos"), accent_insensitive)
    n_mov = A.size0("movimentos")
    cols = {
        "numero_processo": F.col("numero_processo"),
        **t,
        "municipio_fortaleza": X.capital_flag(F.col("orgao_julgador")),
        **s,
        "qtd_movimentos": n_mov,
        "velocidade_movimentos": velocity(n_mov, t["dias_desde_ajuizamento"]),
        "eh_horario_almoco": lunch_flag(F.col("movimentos")),
        "complexidade_score": s["qtd_assuntos"] * n_mov,
        "tem_recurso": X.appeal_flag(F.col("classe")),
    }
    extra = [F.col(c) for c in (keep or [])]
    if date_ok:
        cols["date_ok"] = dates_ok(F.col("data_ajuizamento"), F.col("ultima_atualizacao"))
    return cases.select(*extra, *[c.alias(n) for n, c in cols.items()])


def sex_code(c: Column) -> Column:
    """M -> 0, F -> 1, anything else -> -1."""
    out = F.lit(K.SEX_CODE_DEFAULT)
    for value, code in reversed(list(K.SEX_CODES.items())):
        out = F.when(c == F.lit(value), F.lit(code)).otherwise(out)
    return out.cast("int")


def truthy_code(c: Column) -> Column:
    """C20: True, the text ``True`` and the number 1 -> 1, anything else
    (other texts, other numbers, null) -> 0."""
    is_text = F.typeof(c) == "string"
    yes = F.when(is_text, c.cast("string") == K.TRUE_TEXT).otherwise(c.try_cast("double") == 1)
    return X.flag(yes).cast("int")


def vocabulary(df: DataFrame, col: str, order_col: str) -> list[tuple[str, str]]:
    """(value, column name) of the distinct values of ``col`` in
    first-appearance order (by ``order_col``): the columns of the wide table,
    which a reader of that table holds as its schema anyway. Any number of
    values without a wide schema: :func:`one_hot_long`."""
    rows = df.groupBy(col).agg(F.min(order_col).alias("_first")).orderBy("_first", col)
    return [(r[0], r[1]) for r in rows.select(col, X.slug(F.col(col)).alias("_name")).collect()]


def one_hot_long(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """M8 in rows: ``id_col``, ``feature`` (slug), ``valor`` = 1 for the one
    feature that is set in each row. Any number of distinct values, no
    collect, no shuffle; features that are 0 have no row."""
    return df.where(F.col(col).isNotNull()).select(id_col, X.slug(F.col(col)).alias("feature"), F.lit(1).alias("valor"))


def vocabulary_index(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """value, name, index (0, 1, ...) of the distinct values of ``col``, numbered by first appearance
    without a collect. Values with one slug share a place, the first one's; the last one
    sets it, as in :func:`one_hot_columns`."""
    seen = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.min(order_col).alias("first"))
    place = F.struct("first", "value")
    names = seen.groupBy(X.slug(F.col("value")).alias("name")).agg(F.max_by("value", place).alias("value"), F.min(place).alias("at"))
    return with_sequence(names, [F.col("at.first"), F.col("at.value")], "index").select("value", "name", "index")


def one_hot_sparse(df: DataFrame, col: str, index: DataFrame, vector: str = "vetor") -> DataFrame:
    """M8 as one sparse vector a row, for any number of values: ``df`` with ``vector``, whose size is the
    number of names in ``index`` (of :func:`vocabulary_index`). A value that sets no
    place, null too, gives zeros; an empty vocabulary is an error."""
    from pyspark.ml.feature import OneHotEncoder

    size = index.count()
    if size == 0:
        raise ValueError("an empty vocabulary has no vectors")
    places = index.select(F.col("value").alias("_value"), F.col("index").cast("double").alias("_index"))
    # The place behind the last is the encoder's own for unknown values, and dropped.
    placed = df.join(places, F.col(col) == F.col("_value"), "left").withColumn("_index", F.coalesce("_index", F.lit(float(size))))
    model = OneHotEncoder(inputCol="_index", outputCol=vector, handleInvalid="keep", dropLast=True).fit(places)
    return model.transform(placed).drop("_value", "_index")


def one_hot_columns(col: str, values: list[tuple[str, str]], existing: list[str],
                    on_collision: str = "last") -> dict[str, Column]:
    """M8: name -> 0/1 Column per value, names slugged. A later value with the
    same slug replaces the earlier one (position kept), as does a slug equal
    to an existing column; ``on_collision='error'`` refuses instead."""
    out: dict[str, Column] = {}
    taken = set(existing)
    for v, name in values:
        if on_collision == "error" and (name in out or name in taken):
            raise ValueError(f"one-hot name collision: {name}")
        out[name] = (F.col(col) == F.lit(v)).cast("int")
    return out


def ml_base(joined: DataFrame, order_col: str = "hit_pos") -> DataFrame:
    """Keep ``sucesso`` rows and encode sex and target."""
    kept = joined.filter(F.col("status") == F.lit(K.STATUS_OK))
    return kept.select(
        order_col, *[c for c in FEATURE_COLUMNS if c != "numero_processo"],
        truthy_code(F.col("sentenca_favoravel")).alias("sentenca_favoravel"),
        "texto_decisao",
        sex_code(F.col("sexo_juiz")).alias("sexo_juiz_bin"),
        sex_code(F.col("sexo_requerente")).alias("sexo_requerente_bin"))


def ml_numbered(joined: DataFrame, order_col: str = "hit_pos") -> DataFrame:
    """The encoded rows numbered 1..N in input order.

    Rows of one hit that a multiplying join made come in the order of their
    other values, so the numbering is the same each time."""
    base = ml_base(joined, order_col)
    rest = F.struct(*[c for c in base.columns if c not in (order_col, "texto_decisao")], F.xxhash64("texto_decisao"))
    return with_sequence(base, [F.col(order_col), rest], "id", start=1)


def ml_table(joined: DataFrame, order_col: str = "hit_pos", values: list[tuple[str, str]] | None = None) -> DataFrame:
    """From feature rows joined to enriched records: keep
    ``sucesso``, encode, one-hot the main subject, drop helpers, number 1..N
    in input order. ``values`` (value, column name) are the wide columns;
    without it they are the subjects found."""
    numbered = ml_numbered(joined, order_col)
    vocab = vocabulary(numbered, "assunto_principal", "id") if values is None else values
    fixed = [c for c in numbered.columns if c not in (order_col, "assunto_principal", "id")]
    cols: dict[str, Column] = {"id": F.col("id")}
    cols.update({c: F.col(c) for c in fixed})
    for name, expr in one_hot_columns("assunto_principal", vocab, list(cols)).items():
        cols[name] = expr
    return numbered.select(*[c.alias(n) for n, c in cols.items()])
