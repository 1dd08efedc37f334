"""Scalar column functions: rounding, clamping, draws by key, flow schedules, geometry, colour, paths.

All of them are built from Spark's own functions, so they stay inside generated code.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

C = str | Column


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- rounding, clamping, modulus


def half_even(x: C) -> Column:
    """Round to the nearest integer, ties to even, as a long; never ``round``, which sends ties away from zero."""
    return F.rint(col(x)).cast("long")


def clamp(x: C, lo, hi) -> Column:
    return F.least(F.greatest(col(x), lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi))


def wrap(x: C, n) -> Column:
    """Modulus with the sign of the divisor: -1 wraps to n - 1."""
    return F.pmod(col(x), n if isinstance(n, Column) else F.lit(n))


def ceil_div(a: C, b) -> Column:
    """Ceiling of a / b for integers."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.floor((col(a) + b - 1) / b).cast("long")


def whole_div(a: C, b: C) -> Column:
    """Quotient of two longs, cut to an integer without passing through doubles."""
    return F.call_function("div", col(a), col(b))


def gcd(a: C, b: C, steps: int = 92) -> Column:
    """Greatest common divisor of longs by Euclid's steps in a fold; no pair of longs takes more than 92."""
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.abs(col(a)).cast("long").alias("a"), F.abs(col(b)).cast("long").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b"))),
    )
    return pair["a"]


def lcm(a: C, b: C) -> Column:
    """Least common multiple of longs, in integers; it has to fit into a long itself."""
    return F.when((col(a) == 0) | (col(b) == 0), F.lit(0)).otherwise(whole_div(F.abs(col(a)), gcd(a, b)) * F.abs(col(b)))


def linspace_index(i: C, n: C, k: C) -> Column:
    """Place i of k evenly spaced picks from 0 to n - 1, cut to an integer; a single pick is 0. Integers throughout."""
    return F.when(col(k) <= 1, F.lit(0).cast("long")).otherwise(whole_div(col(i) * (col(n) - 1), F.greatest(col(k) - 1, F.lit(1))))


# ---- draws by key


def unit(*key: C, salt: str = "") -> Column:
    """A number in [0, 1) that depends on the key and the salt alone: the first 32 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def integer_draw(n: C, *key: C, salt: str = "") -> Column:
    """An integer from 0 to n - 1, by key."""
    return F.floor(unit(*key, salt=salt) * col(n)).cast("long")


def normal_draw(*key: C, salt: str = "", limit: float | None = None) -> Column:
    """A standard normal number by key (Box-Muller on two draws), clipped to the limit."""
    u, v = unit(*key, salt=salt + "/u"), unit(*key, salt=salt + "/v")
    z = F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * 3.141592653589793 * v)
    return z if limit is None else clamp(z, -limit, limit)


# ---- flow schedules


def shift_sigma(sigma: C, shift: float) -> Column:
    """Noise level after the time shift: s * x / (1 + (s - 1) * x)."""
    return shift * col(sigma) / (1.0 + (shift - 1.0) * col(sigma))


def noised(clean: C, noise: C, sigma: C) -> Column:
    return (1.0 - col(sigma)) * col(clean) + col(sigma) * col(noise)


def clean_estimate(noisy: C, velocity: C, sigma: C) -> Column:
    """The clean value that a velocity points to; velocity is clean minus noise."""
    return col(noisy) + col(sigma) * col(velocity)


def euler_step(noisy: C, velocity: C, sigma: C, sigma_next: C) -> Column:
    return col(noisy) + (col(sigma) - col(sigma_next)) * col(velocity)


def gaussian_weight(step: C, steps: int) -> Column:
    """Unnormalised training weight of a timestep: a Gaussian around the middle."""
    return F.exp(-2.0 * F.pow((col(step) - steps / 2.0) / steps, 2))


# ---- colour and exposure

#: Luma weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)
#: Fixed values of the two exposure bands.
LIFT_BAND = {"dark_lo": 0.25, "dark_p95_gate": 1.01, "dark_target": 0.25, "bright_hi": 1.01, "bright_target": 0.66}
LOOSE_BAND = {"dark_lo": 0.10, "dark_p95_gate": 0.30, "dark_target": 0.16, "bright_hi": 0.80, "bright_target": 0.66}


def luma(r: C, g: C, b: C) -> Column:
    return LUMA[0] * col(r) + LUMA[1] * col(g) + LUMA[2] * col(b)


def gamma_exponent(median: C, p95: C, band: dict[str, float] | None = None) -> Column:
    """Exponent that moves the median to the band's target; 1 inside the band."""
    b = band or LOOSE_BAND
    dark = (col(median) < b["dark_lo"]) & (col(p95) < b["dark_p95_gate"])
    bright = col(median) > b["bright_hi"]
    return (
        F.when(dark, F.log(F.lit(b["dark_target"])) / F.log(F.greatest(col(median), F.lit(1e-3))))
        .when(bright, F.log(F.lit(b["bright_target"])) / F.log(F.least(col(median), F.lit(1 - 1e-3))))
        .otherwise(F.lit(1.0))
    )


def psnr(mse: C) -> Column:
    """Peak signal-to-noise ratio for values in [0, 1]; null for identical signals."""
    return F.when(col(mse) > 0, -10.0 * F.log10(col(mse)))


# ---- text and paths


def strip(x: C) -> Column:
    """Without white space of any kind at either end; ``trim`` takes spaces only."""
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def normal_path(x: C) -> Column:
    """Path without empty and ``.`` parts, with ``..`` resolved; '.' if nothing is left."""
    text = col(x)
    last = lambda a: F.element_at(a, -1)
    parts = F.aggregate(
        F.split(text, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & F.coalesce(last(acc) != "..", F.lit(True)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & text.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.array_join(parts, "/")
    return F.when(text.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def base_name(x: C) -> Column:
    return F.substring_index(col(x), "/", -1)


def stem(x: C) -> Column:
    """Base name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(x), r"(?<=.)\.[^.]*$", "")


def scene_and_motion(x: C, mark: str = "\n[CHUNK]") -> Column:
    """(scene, motion) of a prompt that has the mark between them; without it the prompt is the motion."""
    at = F.instr(col(x), mark)
    return F.struct(
        F.when(at > 0, F.substr(col(x), F.lit(1), at - 1)).otherwise(col(x)).alias("scene"),
        F.when(at > 0, F.substr(col(x), at + len(mark))).otherwise(col(x)).alias("motion"),
    )


# ---- rational numbers


def limited_fraction(x: float, limit: int = 1024) -> Fraction:
    """Closest fraction with a denominator up to the limit; for tables of rates, not for rows."""
    return Fraction(x).limit_denominator(limit)


def clean_ratio(num: float, den: float, most: int = 2) -> bool:
    """Whether num / den, both made rational first, has a denominator of at most ``most``."""
    d = limited_fraction(den)
    return d == 0 or (limited_fraction(num) / d).denominator <= most


# ---- geometry


def rodrigues(rx: C, ry: C, rz: C) -> Column:
    """Rotation matrix of a rotation vector, as an array of nine numbers by rows."""
    x, y, z = (col(c).cast("double") for c in (rx, ry, rz))
    angle = F.sqrt(x * x + y * y + z * z)
    safe = F.when(angle > 1e-12, angle).otherwise(F.lit(1.0))
    small = angle <= 1e-12
    s = F.when(small, F.lit(1.0)).otherwise(F.sin(angle) / safe)
    c = F.when(small, F.lit(0.5)).otherwise((1.0 - F.cos(angle)) / (safe * safe))
    return F.array(
        1.0 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y,
        c * x * y + s * z, 1.0 - c * (x * x + z * z), c * y * z - s * x,
        c * x * z - s * y, c * y * z + s * x, 1.0 - c * (x * x + y * y),
    )


def mat_vec(m: Column, v: Column) -> Column:
    """Product of a 3x3 matrix (nine numbers) and a vector of three."""
    return F.array(*[sum((m[3 * i + k] * v[k] for k in range(1, 3)), m[3 * i] * v[0]) for i in range(3)])


def mat_mul(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def transposed(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


def camera_centre(r: Column, t: Column) -> Column:
    """Centre of a world-to-camera pose: -R^T t. Also the translation of its inverse."""
    return F.array(*[-sum((r[3 * k + i] * t[k] for k in range(1, 3)), r[i] * t[0]) for i in range(3)])


def world_locked(r: Column, t: Column, r0: Column, t0: Column, r_target: Column) -> tuple[Column, Column]:
    """Pose (r, t) in the world that turns (r0, t0) to ``r_target`` with its centre at the origin."""
    turn = mat_mul(r, transposed(r0))
    moved = mat_vec(turn, t0)
    return mat_mul(turn, r_target), F.array(*[t[i] - moved[i] for i in range(3)])


def projected(fx: C, fy: C, cx: C, cy: C, r: Column, t: Column, point: Column) -> Column:
    """(u, v, depth) of a world point through a pinhole camera."""
    p = mat_vec(r, point)
    x, y, z = (p[i] + t[i] for i in range(3))
    return F.struct((col(fx) * x / z + col(cx)).alias("u"), (col(fy) * y / z + col(cy)).alias("v"), z.alias("depth"))


def normal_intrinsics(fx: C, fy: C, cx: C, cy: C, width: C, height: C) -> Column:
    """Intrinsics in units of the image's size."""
    return F.array(col(fx) / col(width), col(fy) / col(height), col(cx) / col(width), col(cy) / col(height))


def pose_rows(flat: C, width: int = 10) -> Column:
    """A flat list of ``width`` numbers a frame, as an array of arrays."""
    n = F.floor(F.size(col(flat)) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(col(flat), i * width + 1, width))).otherwise(F.array().cast("array<array<double>>"))
