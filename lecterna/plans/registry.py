"""The operator registry: masks of requested work become a plan.

A task asks for operators by a bit mask. Which operators run, and in which
order, is settled when the plan is built; rows never change state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Operator bits.
BITS = {
    "ACT": 1, "FACEDET": 2, "FACEREC": 4, "FACEORI": 8, "EXPRESS": 16, "4CLS": 32, "VOICEPRINT": 64, "RAISEHANDCLS": 128, "FINDTEACHER": 256, "CLASSTYPE": 512, "FACE_SCORE": 2048, "WBCLS": 4096,
    "ASR_ENCODE": 0x10000, "ASR_VAD": 0x20000, "T5": 0x40000, "PUNC": 0x80000, "ASR_DECODE": 0x100000, "SOUND_C5": 0x200000, "OCR_DET": 0x400000, "OCR_REC": 0x800000, "POSE": 0x1000000,
    "BOARD_DET": 0x20000000, "PHONE_DET": 0x40000000, "ASR_PREDICTOR": 0x80000000, "ASR_STAMP": 0x100000000, "SENSEVOICE": 0x200000000, "T5_ENCODER": 0x400000000, "T5_DEC1ST": 0x800000000, "T5_DECKVS": 0x1000000000,
}

DESCRIPTOR = (
    "name string, mid long, model_path string, input array<struct<name:string,dtype:string,shape:array<int>>>, depend array<long>, "
    "backend array<struct<type:string,model_path:string,backend_cfg:struct<force_cpu:boolean,balance_ratio:double,intra_op_num_threads:int,inter_op_num_threads:int,providers:array<string>,providers_cfg:array<map<string,string>>>>>"
)


@dataclass(frozen=True)
class Operator:
    """One operator. ``transform`` gives a table the columns it adds; where rows
    ask one by one (``plan_rows``), ``columns`` gives the same as expressions."""

    name: str
    mid: int
    transform: Callable[[DataFrame], DataFrame] | None = None
    depends: tuple[int, ...] = ()
    inputs: tuple[str, ...] = ()
    output: StructType | None = None
    columns: Callable[[], dict[str, Column]] | None = None

    def applied(self, df: DataFrame) -> DataFrame:
        return self.transform(df) if self.transform is not None else df.withColumns(self.columns() if self.columns else {})


@dataclass
class Registry:
    operators: dict[int, Operator] = field(default_factory=dict)

    def add(self, op: Operator) -> Operator:
        if op.mid <= 0 or op.mid in self.operators:
            raise ValueError(f"operator bit {op.mid} is taken or not positive")
        self.operators[op.mid] = op
        return op

    @property
    def supported(self) -> int:
        mask = 0
        for m in self.operators:
            mask |= m
        return mask

    def ordered(self, mask: int) -> list[Operator]:
        """The operators of a mask and all they depend on, dependencies first, then by bit."""
        if mask & ~self.supported:
            raise ValueError(f"unsupported operators: {names(mask & ~self.supported)}")
        done: list[int] = []

        def visit(m: int, path: tuple[int, ...]) -> None:
            if m in done:
                return
            if m in path:
                raise ValueError(f"operators depend on each other: {path}")
            if m not in self.operators:
                raise ValueError(f"operator {m} is required but not registered")
            for d in sorted(self.operators[m].depends):
                visit(d, (*path, m))
            done.append(m)

        for m in sorted(m for m in self.operators if m & mask):
            visit(m, ())
        return [self.operators[m] for m in done]

    def plan(self, df: DataFrame, mask: int) -> DataFrame:
        """``df`` with the results of the operators of ``mask``; operators that
        weren't asked for, and that no other needs, aren't in the plan at all."""
        for op in self.ordered(mask):
            missing = [c for c in op.inputs if c not in df.columns]
            if missing:
                raise ValueError(f"{op.name} needs the columns {missing}")
            df = op.applied(df)
        return df

    def plan_rows(self, df: DataFrame, todo: str = "todo") -> DataFrame:
        """Each operator over the rows that ask for it or for one that depends on
        it; results for the others are null. Operators of expressions are columns
        of one pass. One that works on whole tables gets the rows that ask for it, once,
        and its results join by ``_row``, so that the plan grows with the operators."""
        checked = validated(df, todo, self.supported)
        wanted = self.wanted()
        for op in self.ordered(self.supported):
            asked = F.col(todo).bitwiseAND(F.lit(wanted[op.mid])) != 0
            if op.columns is not None:
                checked = checked.withColumns({k: F.when(asked, c) for k, c in op.columns().items()})
                continue
            from lecterna.plans.lineage import written

            base = written(checked.withColumn("_row", F.monotonically_increasing_id()), "rows")
            ran = op.transform(base.where(asked))
            new = [c for c in ran.columns if c not in base.columns]
            checked = base.join(ran.select("_row", *new), "_row", "left").drop("_row")
        return checked

    def wanted(self) -> dict[int, int]:
        """For each operator the bits that call for it: its own and those of all that depend on it."""
        out = {m: m for m in self.operators}
        for op in reversed(self.ordered(self.supported)):
            for d in op.depends:
                out[d] |= out[op.mid]
        return out

    def descriptors(self, spark: SparkSession, model_dir: str = "") -> DataFrame:
        """The registered operators as descriptors, in dependency order."""
        rows = [(op.name.lower(), op.mid, f"{model_dir}/{op.name.lower()}", list(op.depends)) for op in self.ordered(self.supported)]
        return spark.createDataFrame(rows, "name string, mid long, model_path string, depend array<long>")


def names(mask: int, bits: dict[str, int] = BITS) -> str:
    """Names of a mask in the order of declaration."""
    return "|".join(k for k, v in bits.items() if mask & v == v) or "None"


def mask_names(todo: Column, bits: dict[str, int] = BITS) -> Column:
    """As ``names``, for a column."""
    parts = F.filter(F.array(*[F.when(todo.bitwiseAND(F.lit(v)) == v, F.lit(k)) for k, v in bits.items()]), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, F.lit("None")).otherwise(F.array_join(parts, "|"))


def bits_of(todo: Column) -> Column:
    """The set bits of a mask."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda b: todo.bitwiseAND(b) != 0)


def supported_mask(df: DataFrame, by: list[str], mid: str) -> DataFrame:
    return df.groupBy(*by).agg(F.expr(f"bit_or({mid})").alias("supported"))


def validated(df: DataFrame, todo: str, supported: int) -> DataFrame:
    """``df``; a row that asks for something unsupported fails the query."""
    bad = F.col(todo).bitwiseAND(F.lit(~supported)) != 0
    return df.withColumn(todo, F.when(bad, F.raise_error(F.concat(F.lit("unsupported operators in mask "), F.col(todo).cast("string"))).cast("long")).otherwise(F.col(todo)))


def remaining(df: DataFrame, key: list[str], todo: str, done: str) -> DataFrame:
    """(key, remaining): what of the mask isn't done yet."""
    return df.groupBy(*key).agg(F.max(todo).alias("_t"), F.expr(f"bit_or({done})").alias("_d")).select(*key, F.col("_t").bitwiseAND(F.bitwise_not(F.coalesce("_d", F.lit(0).cast("long")))).alias("remaining"))


def dispatched(df: DataFrame, todo: str, order: list[int], name: dict[int, str]) -> DataFrame:
    """``df`` with the first operator, in dependency order, that its mask asks for."""
    pick = F.coalesce(*[F.when(F.col(todo).bitwiseAND(F.lit(m)) != 0, F.lit(name[m])) for m in order])
    return df.withColumn("operator", pick)


def powers(n: Column, largest: int) -> Column:
    """A batch of n in powers of two of at most ``largest``, the large ones first."""
    parts, size = [], largest
    while size >= 1:
        k = F.floor(n / size) if size == largest else F.floor((n % (size * 2)) / size)
        parts.append(F.array_repeat(F.lit(size), k.cast("int")))
        size //= 2
    return F.concat(*parts)


def depth(spark: SparkSession, deps: Iterable[tuple[int, int]]) -> DataFrame:
    """(mid, depth) of (mid, depends on) pairs: the longest chain below each operator."""
    return spark.sql(
        """
        WITH RECURSIVE d(mid, depth) AS (
            SELECT DISTINCT dep, 0 FROM {deps} WHERE dep NOT IN (SELECT mid FROM {deps})
            UNION ALL SELECT x.mid, d.depth + 1 FROM {deps} x JOIN d ON x.dep = d.mid)
        SELECT mid, max(depth) AS depth FROM d GROUP BY mid""",
        deps=spark.createDataFrame(list(deps), "mid long, dep long"),
    )


def missing(df: DataFrame) -> DataFrame:
    """(mid, dep): dependencies of descriptors that no descriptor provides."""
    need = df.select("mid", F.explode("depend").alias("dep"))
    return need.join(df.select(F.col("mid").alias("dep")).distinct(), "dep", "left_anti").select("mid", "dep")


def backend(df: DataFrame, order: list[str], ratios: list[float]) -> DataFrame:
    """``df`` with ``backend``: rows dealt in turn, in proportion to 1/ratio (the
    least loaded backend first, each use adding its ratio)."""
    score, turn = [0.0] * len(ratios), []
    for _ in range(max(1, round(sum(1 / r for r in ratios) / min(1 / r for r in ratios)))):
        i = min(range(len(ratios)), key=lambda k: (score[k], k))
        score[i] += ratios[i]
        turn.append(i)
    return df.withColumn("backend", F.element_at(F.array(*[F.lit(i) for i in turn]), (F.pmod(F.xxhash64(*order), F.lit(len(turn))) + 1).cast("int")))
