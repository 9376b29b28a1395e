"""Inverse normal distribution as a plain expression (Wichura 1988, PPND16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of algorithm AS241, highest power first.
_CENTRE = (
    ("2509.0809287301226727", "33430.575583588128105", "67265.770927008700853", "45921.953931549871457", "13731.693765509461125", "1971.5909503065514427", "133.14166789178437745", "3.3871328727963666080"),
    ("5226.4952788528545610", "28729.085735721942674", "39307.895800092710610", "21213.794301586595867", "5394.1960214247511077", "687.18700749205790830", "42.313330701600911252", "1.0"),
)
_NEAR = (
    ("7.74545014278341407640e-4", "2.27238449892691845833e-2", "2.41780725177450611770e-1", "1.27045825245236838258", "3.64784832476320460504", "5.76949722146069140550", "4.63033784615654529590", "1.42343711074968357734"),
    ("1.05075007164441684324e-9", "5.47593808499534494600e-4", "1.51986665636164571966e-2", "1.48103976427480074590e-1", "6.89767334985100004550e-1", "1.67638483018380384940", "2.05319162663775882187", "1.0"),
)
_FAR = (
    ("2.01033439929228813265e-7", "2.71155556874348757815e-5", "1.24266094738807843860e-3", "2.65321895265761230930e-2", "2.96560571828504891230e-1", "1.78482653991729133580", "5.46378491116411436990", "6.65790464350110377720"),
    ("2.04426310338993978564e-15", "1.42151175831644588870e-7", "1.84631831751005468180e-5", "7.86869131145613259100e-4", "1.48753612908506148525e-2", "1.36929880922735805310e-1", "5.99832206555887937690e-1", "1.0"),
)


def _ratio(parts, r: str, number) -> str:
    def horner(cs):
        out = number(cs[0])
        for c in cs[1:]:
            out = f"({out} * {r} + {number(c)})"
        return out

    return f"({horner(parts[0])} / {horner(parts[1])})"


def inverse_normal_sql(p: str, number=lambda c: f"CAST('{c}' AS DOUBLE)") -> str:
    """SQL text of the inverse normal of the expression ``p``, which is inside (0, 1)."""
    q = f"({p} - {number('0.5')})"
    tail = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN {p} ELSE {number('1.0')} - {p} END))"
    sign = f"(CASE WHEN {q} < 0 THEN {number('-1.0')} ELSE {number('1.0')} END)"
    centre = _ratio(_CENTRE, f"({number('0.180625')} - {q} * {q})", number)
    near = _ratio(_NEAR, f"({tail} - {number('1.6')})", number)
    far = _ratio(_FAR, f"({tail} - {number('5.0')})", number)
    return f"CASE WHEN abs({q}) <= {number('0.425')} THEN {q} * {centre} WHEN {tail} <= {number('5.0')} THEN {sign} * {near} ELSE {sign} * {far} END"


def _polynomials(parts, r: Column) -> Column:
    def horner(cs):
        out = F.lit(float(cs[0]))
        for c in cs[1:]:
            out = out * r + F.lit(float(c))
        return out

    return horner(parts[0]) / horner(parts[1])


def with_inverse_normal(df: DataFrame, p: Column, out: str) -> DataFrame:
    """Add the inverse normal of ``p``, clipped to [1e-6, 1 - 1e-6]; missing stays missing.

    Parts that are used again are columns of an earlier projection, so that the generated code stays small.
    """
    df = df.withColumn("_p", F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))))
    df = df.withColumn("_q", F.col("_p") - 0.5)
    q = F.col("_q")
    df = df.withColumn("_r", F.when(F.abs(q) <= 0.425, F.lit(0.180625) - q * q).otherwise(F.sqrt(-F.log(F.when(q <= 0, F.col("_p")).otherwise(1 - F.col("_p"))))))
    r, sign = F.col("_r"), F.when(q < 0, -1.0).otherwise(1.0)
    centre, near, far = q * _polynomials(_CENTRE, r), sign * _polynomials(_NEAR, r - 1.6), sign * _polynomials(_FAR, r - 5.0)
    return df.withColumn(out, F.when(F.abs(q) <= 0.425, centre).when(r <= 5.0, near).otherwise(far)).drop("_p", "_q", "_r")


def with_bell_curve(df: DataFrame, pct: str, out: str, mean=50.0, sd=18.0, floor=5.0, cap=100.0) -> DataFrame:
    """add a percentile (0 to 100) on a normal scale, clipped to [floor, cap]; missing stays missing.

    The shape may be given by columns.
    """
    mean, sd, floor, cap = (x if isinstance(x, Column) else F.lit(x) for x in (mean, sd, floor, cap))
    df = with_inverse_normal(df, F.col(pct) / 100.0, "_z")
    return df.withColumn(out, F.when(F.col("_z").isNotNull(), F.least(F.greatest(mean + sd * F.col("_z"), floor), cap))).drop("_z")
