"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _F, _D = T.StringType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()
_TS, _DAY = T.TimestampType(), T.TimestampNTZType()

GRID_DAILY = _struct(
    ("cenario", _S), ("variavel", _S), ("arquivo", _S), ("t", _DAY), ("ano", _I),
    ("iy", _I), ("ix", _I), ("lat", _F), ("lon", _F), ("valor", _F),
    ("units", _S), ("calendario", _S),
)

CELL_MAP = _struct(("grid_id", _S), ("iy", _I), ("ix", _I), ("municipio_id", _L))

MUN_DAILY = _struct(
    ("cenario", _S), ("variavel", _S), ("municipio_id", _L), ("t", _DAY), ("valor", _D),
)

RESULT_INDEX = _struct(
    ("id", _S), ("execucao_id", _S), ("lat", _D), ("lon", _D), ("lat_input", _D),
    ("lon_input", _D), ("ano", _I), ("nome_indice", _S), ("valor", _D), ("unidade", _S),
    ("municipio_id", _L),
)

WATER_STRESS = _struct(
    ("id", _S), ("execucao_id", _S), ("municipio_id", _L), ("ano", _I), ("cenario", _S),
    ("frequencia_dias_secos_quentes", _I), ("intensidade_mm_dia", _D), ("criado_em", _TS),
)

RUN = _struct(
    ("id", _S), ("cenario", _S), ("variavel", _S), ("arquivo_origem", _S), ("tipo", _S),
    ("parametros", _S), ("status", _S), ("criado_em", _TS), ("concluido_em", _TS), ("job_id", _S),
)

MUNICIPALITY = _struct(
    ("id", _L), ("nome", _S), ("nome_normalizado", _S), ("uf", _S),
    ("lat_centroide", _D), ("lon_centroide", _D), ("atualizado_em", _TS),
)

SUPPLIER_SITE = _struct(
    ("id", _S), ("nome", _S), ("cidade", _S), ("uf", _S), ("lat", _D), ("lon", _D),
    ("municipio_id", _L), ("criado_em", _TS), ("atualizado_em", _TS),
)

EDGE = _struct(
    ("municipio_id", _L), ("part", _I), ("ring", _I), ("k", _I),
    ("x1", _D), ("y1", _D), ("x2", _D), ("y2", _D),
)

# The closed set of run states.
RUN_STATUS = ("pending", "running", "completed", "failed", "canceled")
