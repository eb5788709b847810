"""Parameters and filters, validated when they are built."""

from __future__ import annotations

from dataclasses import dataclass, field

from garoa.errors import ValidationError

# The functions and dimensions an aggregation may name.
AGGREGATIONS = ("media", "min", "max", "count", "p50", "p95")
DIMENSIONS = ("ano", "cenario", "variavel", "nome_indice", "municipio")


@dataclass(frozen=True)
class YearRange:
    """Closed interval of years."""

    inicio: int
    fim: int

    def __post_init__(self) -> None:
        if self.inicio > self.fim:
            raise ValidationError(f"inicio must be <= fim, got {self.inicio} > {self.fim}")


@dataclass(frozen=True)
class RainParams:
    """Thresholds of the eight rainfall indices, in mm/day."""

    freq_thr_mm: float = 20.0
    heavy_thresholds: tuple[float, float] = (20.0, 50.0)
    p95_wet_thr: float = 1.0
    baseline: YearRange | None = None


@dataclass(frozen=True)
class StressParams:
    """Limits of a dry (mm/day) and of a hot (degrees Celsius) day."""

    limiar_pr_mm_dia: float = 1.0
    limiar_tas_c: float = 30.0


@dataclass(frozen=True)
class BBox:
    """Closed box in degrees; ``lon_min > lon_max`` crosses the antimeridian."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float

    def __post_init__(self) -> None:
        if self.lat_min > self.lat_max:
            raise ValidationError(f"lat_min must be <= lat_max, got {self.lat_min} > {self.lat_max}")


@dataclass(frozen=True)
class Radius:
    """Circle of ``km`` around a centre."""

    lat: float
    lon: float
    km: float

    def __post_init__(self) -> None:
        if self.km <= 0:
            raise ValidationError("raio_km must be greater than zero")


@dataclass(frozen=True)
class Page:
    """One page of an ordered listing; ``most`` is the longest page the caller allows, if any."""

    limit: int = 100
    offset: int = 0
    most: int | None = None

    def __post_init__(self) -> None:
        if self.limit <= 0 or (self.most is not None and self.limit > self.most):
            raise ValidationError(f"limit must be in (0, {self.most or 'any'}], got {self.limit}")
        if self.offset < 0:
            raise ValidationError(f"offset must be >= 0, got {self.offset}")


def _check_years(ano: int | None, ano_min: int | None, ano_max: int | None) -> None:
    if ano is not None and (ano_min is not None or ano_max is not None):
        raise ValidationError("ano excludes ano_min and ano_max")
    if ano_min is not None and ano_max is not None and ano_min > ano_max:
        raise ValidationError("ano_min must not exceed ano_max")


@dataclass(frozen=True)
class ResultFilter:
    """Optional AND conditions over stored index results; ``None`` means any."""

    execucao_id: str | None = None
    cenario: str | None = None
    variavel: str | None = None
    ano: int | None = None
    ano_min: int | None = None
    ano_max: int | None = None
    nomes_indices: tuple[str, ...] = ()
    lat_min: float | None = None
    lat_max: float | None = None
    lon_min: float | None = None
    lon_max: float | None = None
    uf: str | None = None
    municipio_id: int | None = None
    raio_km: float | None = None
    centro_lat: float | None = None
    centro_lon: float | None = None

    def __post_init__(self) -> None:
        _check_years(self.ano, self.ano_min, self.ano_max)
        given = [v is not None for v in (self.raio_km, self.centro_lat, self.centro_lon)]
        if any(given) and not all(given):
            raise ValidationError("raio_km, centro_lat and centro_lon go together")
        if all(given):
            Radius(self.centro_lat, self.centro_lon, self.raio_km)

    @property
    def bbox(self) -> BBox | None:
        """The box, when all four sides are given."""
        sides = (self.lat_min, self.lat_max, self.lon_min, self.lon_max)
        return BBox(*sides) if all(s is not None for s in sides) else None

    @property
    def radius(self) -> Radius | None:
        """The circle, when asked for; it then takes the place of the box."""
        if self.raio_km is None:
            return None
        return Radius(self.centro_lat, self.centro_lon, self.raio_km)


@dataclass(frozen=True)
class StressFilter:
    """Optional AND conditions over stored water-stress results."""

    execucao_id: str | None = None
    cenario: str | None = None
    ano: int | None = None
    ano_min: int | None = None
    ano_max: int | None = None
    municipio_id: int | None = None
    uf: str | None = None

    def __post_init__(self) -> None:
        _check_years(self.ano, self.ano_min, self.ano_max)


@dataclass(frozen=True)
class Aggregation:
    """A function over ``valor`` and the dimensions to group by, in order."""

    funcao: str = "media"
    dimensoes: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.funcao not in AGGREGATIONS:
            raise ValidationError(f"unknown aggregation {self.funcao!r}; use one of {AGGREGATIONS}")
        unknown = [d for d in self.dimensoes if d not in DIMENSIONS]
        if unknown:
            raise ValidationError(f"unknown dimensions {unknown}; use {DIMENSIONS}")
