"""Mathematical functions of the dialect as Spark SQL."""

from __future__ import annotations

from tessera.functions.expr import Expr, rule, same, template

same("acos acosh asin asinh atan atan2 atanh cbrt cos cosh cot csc exp sec sin sinh tan tanh pow power log10", "FLOAT64")
template("COTH", "(1D / tanh({0}))", "FLOAT64")
template("CSCH", "(1D / sinh({0}))", "FLOAT64")
template("SECH", "(1D / cosh({0}))", "FLOAT64")
template("DIV", "({0} div {1})", "INT64")
template("RAND", "rand()", "FLOAT64")
template("IS_INF", "(abs({0}) = double('infinity'))", "BOOL")
template("IS_NAN", "if(({0}) IS NULL, NULL, isnan({0}))", "BOOL")
template("LN", "if({0} <= 0, raise_error('LN needs a positive number'), ln({0}))", "FLOAT64")
template("SQRT", "if({0} < 0, raise_error('SQRT needs a number that is not negative'), sqrt({0}))", "FLOAT64")
template("SAFE_ADD", "try_add({0}, {1})")
template("SAFE_SUBTRACT", "try_subtract({0}, {1})")
template("SAFE_MULTIPLY", "try_multiply({0}, {1})")
template("SAFE_NEGATE", "try_subtract(0L, {0})")
template("SAFE_DIVIDE", "try_divide({0}, {1})", "FLOAT64")
template(
    "IEEE_DIVIDE",
    "(CASE WHEN {1} <> 0 THEN {0} / {1} WHEN {0} = 0 OR isnan({0}) THEN double('NaN') WHEN {0} > 0 THEN double('infinity') WHEN {0} < 0 THEN -double('infinity') END)",
    "FLOAT64",
)
template("RANGE_BUCKET", "if(({0}) IS NULL OR ({1}) IS NULL, NULL, cast(size(filter({1}, _b -> _b <= {0})) AS bigint))", "INT64")


@rule("ABS")
def abs_(x):
    return Expr(f"abs({x})", x.type)


@rule("MOD")
def mod(x, y):
    return Expr(f"mod({x}, {y})", x.type)


def _whole(f):
    def cut(x):
        """FLOAT64 stays FLOAT64, where Spark gives an integer; decimals stay decimals."""
        if x.type in ("NUMERIC", "BIGNUMERIC"):
            return Expr(f"cast({f}({x}) AS decimal(38,9))", "NUMERIC")
        # integers and finite doubles; infinities and NaN have no integer form
        return Expr(f"if(abs({x}) < 9e15D, cast({f}({x}) AS double), cast({x} AS double))", "FLOAT64")

    return cut


rule("CEIL", "CEILING")(_whole("ceil"))
rule("FLOOR")(_whole("floor"))


@rule("ROUND")
def round_(x, n="0", mode=None):
    f = "bround" if mode is not None and "EVEN" in str(mode).upper() else "round"
    n = str(n).removesuffix("L")
    if x.type in ("NUMERIC", "BIGNUMERIC"):
        return Expr(f"cast({f}({x}, {n}) AS decimal(38,9))", "NUMERIC")
    return Expr(f"{f}(cast({x} AS double), {n})" if x.type == "INT64" else f"{f}({x}, {n})", "FLOAT64")


@rule("TRUNC")
def trunc(x, n="0"):
    n = str(n).removesuffix("L")
    scale = f"pow(10D, {n})"
    return Expr(f"(signum({x}) * floor(abs({x}) * {scale}) / {scale})", "FLOAT64")


@rule("SIGN")
def sign(x):
    if x.type == "INT64":
        return Expr(f"cast(signum({x}) AS bigint)", "INT64")
    return Expr(f"signum({x})", x.type or "FLOAT64")


@rule("LOG", type="FLOAT64")
def log(x, base=None):
    return f"ln({x})" if base is None else f"log({base}, {x})"


def _extreme(f):
    def pick(*args):
        """Null if any argument is, unlike Spark; NaN wins in both directions."""
        if not args:
            raise TypeError("needs an argument")
        if len(args) == 1:
            return Expr(args[0], args[0].type)
        nulls = " OR ".join(f"({a}) IS NULL" for a in args)
        return Expr(f"if({nulls}, NULL, {f}({', '.join(args)}))", args[0].type)

    return pick


rule("GREATEST")(_extreme("greatest"))
rule("LEAST")(_extreme("least"))
