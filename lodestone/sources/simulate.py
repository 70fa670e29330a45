"""Simulated property graphs with known causes, as triples or as the flat table, at any size.

Every value is an expression of hashed row numbers, so rows are made in parallel and are the same however they are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import normal, uniform


@dataclass(frozen=True)
class Variable:
    """levels in order; a root is drawn evenly, others are where the score passes the cuts: weights times the parents'
    level numbers, plus normal noise around `shift` of deviation `noise`."""

    cls: str
    levels: tuple[str, ...]
    weights: dict[str, float] = field(default_factory=dict)
    cuts: tuple[float, ...] = ()
    shift: float = 0.0
    noise: float = 0.4


# Levels, weights and cuts of the three-class clinic.
CLINIC = {
    "age": Variable("Patient", ("Young", "Middle", "Old")),
    "smoking": Variable("Patient", ("No", "Yes")),
    "geneticRisk": Variable("Patient", ("Low", "High")),
    "region": Variable("Hospital", ("North", "South", "East", "West")),
    "airPollution": Variable("Hospital", ("Low", "Medium", "High"), {"region": 0.8}, (0.8, 1.6)),
    "careQuality": Variable("Hospital", ("Low", "Medium", "High"), {}, (0.7, 1.5), 1.5, 0.7),
    "tumorStage": Variable("Patient", ("I", "II", "III", "IV"), {"age": 0.35, "smoking": 0.7, "geneticRisk": 0.6, "airPollution": 0.6}, (0.6, 1.4, 2.2)),
    "drugClass": Variable("Therapy", ("A", "B", "C")),
    "dosage": Variable("Therapy", ("Low", "Medium", "High"), {"tumorStage": 0.8}, (0.7, 1.5)),
    "toxicity": Variable("Therapy", ("Low", "High"), {"drugClass": 0.5, "dosage": 0.8}, (1.2,)),
    "survival": Variable("Patient", ("Short", "Medium", "Long"), {"tumorStage": -0.5, "careQuality": 0.5, "toxicity": -1.0}, (1.0, 2.0), 1.9),
}


def truth(variables: dict[str, Variable] = CLINIC) -> list[tuple[str, str]]:
    """The causal edges, as variable names with their class."""
    return sorted((f"{variables[p].cls}__{p}", f"{v.cls}__{name}") for name, v in variables.items() for p in v.weights)


def _level(v: Variable, name: str, key: Column, seed: int, scores: dict[str, Column]) -> Column:
    """The number of the level."""
    if not v.weights and not v.cuts:
        return F.floor(uniform(seed, F.lit(name), key) * len(v.levels)).cast("int")
    score = sum((w * scores[p] for p, w in v.weights.items()), F.lit(v.shift) + v.noise * normal(seed, F.lit(name), key))
    return sum((F.when(score >= c, 1).otherwise(0) for c in v.cuts), F.lit(0))


def clinic(spark: SparkSession, patients: int = 500, hospitals: int = 20, most_therapies: int = 4, seed: int = 0) -> DataFrame:
    """One row for each therapy with its patient and hospital: patient, hospital, therapy and a number column for each variable.

    Survival depends on the patient's mean toxicity, so a patient's therapies are kept in an array until it is known.
    """
    pid = F.col("id")
    hospital = F.floor(uniform(seed + 1, F.lit("hospital"), pid) * hospitals).cast("long")
    rows = spark.range(patients).select(pid.alias("patient"), hospital.alias("hospital"), (F.floor(uniform(seed + 2, F.lit("count"), pid) * most_therapies) + 1).cast("int").alias("n"))
    for i, name in enumerate(("region", "airPollution", "careQuality", "age", "smoking", "geneticRisk", "tumorStage")):
        v = CLINIC[name]
        key = F.col("hospital") if v.cls == "Hospital" else F.col("patient")
        rows = rows.withColumn(name, _level(v, name, key, seed + 10 * (i + 1), {p: F.col(p) for p in v.weights}))

    def therapy(k: Column) -> Column:
        key = F.col("patient") * most_therapies + k
        drug = _level(CLINIC["drugClass"], "drugClass", key, seed + 100, {})
        dosage = _level(CLINIC["dosage"], "dosage", key, seed + 110, {"tumorStage": F.col("tumorStage")})
        return F.struct(key.alias("therapy"), drug.alias("drugClass"), dosage.alias("dosage"), _level(CLINIC["toxicity"], "toxicity", key, seed + 120, {"drugClass": drug, "dosage": dosage}).alias("toxicity"))

    rows = rows.withColumn("therapies", F.transform(F.sequence(F.lit(0), F.col("n") - 1), therapy))
    mean = F.aggregate("therapies", F.lit(0.0), lambda a, t: a + t["toxicity"]) / F.col("n")
    rows = rows.withColumn("survival", _level(CLINIC["survival"], "survival", F.col("patient"), seed + 130, {"tumorStage": F.col("tumorStage"), "careQuality": F.col("careQuality"), "toxicity": mean}))
    return rows.withColumn("t", F.explode("therapies")).select("patient", "hospital", "t.*", *[c for c in CLINIC if c not in ("drugClass", "dosage", "toxicity")])


def flat(rows: DataFrame) -> DataFrame:
    """The flat table: entity columns and level names as Class__variable."""
    named = [F.element_at(F.array(*map(F.lit, v.levels)), F.col(n) + 1).alias(f"{v.cls}__{n}") for n, v in sorted(CLINIC.items(), key=lambda x: (x[1].cls, x[0]))]
    return rows.select(*[F.concat(F.lit(f"{c.lower()}_"), F.col(c.lower()).cast("string")).alias(c) for c in ("Hospital", "Patient", "Therapy")], *named)


def as_triples(rows: DataFrame) -> DataFrame:
    """The same graph as (s, p, o, o_kind), each triple once."""
    table = flat(rows)
    made = []
    for cls in ("Hospital", "Patient", "Therapy"):
        made.append(F.struct(F.col(cls).alias("s"), F.lit("rdf:type").alias("p"), F.lit(cls).alias("o"), F.lit("iri").alias("o_kind")))
        made += [F.struct(F.col(cls).alias("s"), F.lit(n).alias("p"), F.col(f"{cls}__{n}").alias("o"), F.lit("literal").alias("o_kind")) for n, v in CLINIC.items() if v.cls == cls]
    made += [F.struct(F.col("Patient").alias("s"), F.lit(p).alias("p"), F.col(to).alias("o"), F.lit("iri").alias("o_kind")) for p, to in (("treatedAt", "Hospital"), ("receives", "Therapy"))]
    return table.select(F.explode(F.array(*made)).alias("t")).select("t.*").distinct()


def linear(spark: SparkSession, weights: dict[str, dict[str, float]], n: int, noise: float = 1.0, seed: int = 0, uniform_noise: bool = False) -> DataFrame:
    """id and a column for each variable of a linear model, given in an order of causes before effects."""
    out = spark.range(n)
    for i, (name, parents) in enumerate(weights.items()):
        e = (uniform(seed + 2 * i, F.lit(name), F.col("id")) - 0.5) * (2 * 3**0.5) if uniform_noise else normal(seed + 2 * i, F.lit(name), F.col("id"))
        out = out.withColumn(name, sum((F.col(p) * w for p, w in parents.items()), noise * e))
    return out
