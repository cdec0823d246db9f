"""SQL text shared by the oracle statements."""

from __future__ import annotations

from tidemark.functions.numeric import HART_DENOMINATOR, HART_LIMIT, HART_NUMERATOR, SQRT_TWO_PI


def D(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def PHI(z: str) -> str:
    """Normal CDF of the SQL expression ``z`` from the same published coefficients as the Column form."""

    def horner(a: str, cs: list[float]) -> str:
        out = D(cs[0])
        for c in cs[1:]:
            out = f"({out} * {a} + {D(c)})"
        return out

    a = f"abs({z})"
    e = f"exp(-{a} * {a} / 2.0::DOUBLE)"
    tail = f"({a} + {D(0.65)})"
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = f"({a} + {D(k)} / {tail})"
    upper = f"(CASE WHEN {a} < {D(HART_LIMIT)} THEN {e} * {horner(a, HART_NUMERATOR)} / {horner(a, HART_DENOMINATOR)} WHEN {a} <= 37 THEN {e} / {tail} / {D(SQRT_TWO_PI)} ELSE 0.0::DOUBLE END)"
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) > 0 THEN 1.0::DOUBLE - {upper} ELSE {upper} END)"


def LOGIT(p: str, eps: float = 1e-6) -> str:
    c = CLIP(p, eps, 1 - eps)
    return f"ln({c} / (1.0::DOUBLE - {c}))"


def CLIP(x: str, lo: float, hi: float) -> str:
    return f"greatest(least({x}, {D(hi)}), {D(lo)})"


def LOGLOSS(p: str, y: str, eps: float = 1e-6) -> str:
    c = CLIP(p, eps, 1 - eps)
    return f"(-({y} * ln({c}) + (1.0::DOUBLE - {y}) * ln(1.0::DOUBLE - {c})))"


def DRAW(parts: str, n: str) -> str:
    """Counter-based draw in [0, n)."""
    return f"(CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT) % {n})"
