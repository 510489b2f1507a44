"""Small colored grids as arrays of arrays: checks, symmetries, colors, families, programs, votes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import SplitMix

# Names of the eight symmetries in their order.
SYMMETRIES = ["identity", "rot90", "rot180", "rot270", "flip_h", "flip_v", "transpose", "anti_transpose"]
COLORS, MAX_SIDE, MAX_MADE = 10, 30, 8


def is_grid(g: Column) -> Column:
    """Rows of one length, 1 to 30 both ways, colors 0 to 9; null isn't a grid."""
    sides = F.size(g).between(1, MAX_SIDE) & F.size(g[0]).between(1, MAX_SIDE)
    return F.coalesce(sides & F.forall(g, lambda r: (F.size(r) == F.size(g[0])) & F.forall(r, lambda c: c.between(0, COLORS - 1))), F.lit(False))


def transpose(g: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(g, 1))), lambda k: F.transform(g, lambda r: F.element_at(r, k)))


def mirror(g: Column) -> Column:
    """Each row backwards."""
    return F.transform(g, lambda r: F.reverse(r))


def symmetry(g: Column, name: str) -> Column:
    """One of the eight symmetries; rotations are clockwise."""
    return {
        "identity": lambda: g,
        "rot90": lambda: transpose(F.reverse(g)),
        "rot180": lambda: mirror(F.reverse(g)),
        "rot270": lambda: F.reverse(transpose(g)),
        "flip_h": lambda: mirror(g),
        "flip_v": lambda: F.reverse(g),
        "transpose": lambda: transpose(g),
        "anti_transpose": lambda: mirror(F.reverse(transpose(g))),
    }[name]()


def inverse(name: str) -> str:
    return {"rot90": "rot270", "rot270": "rot90"}.get(name, name)


def recolor(g: Column, permutation: list[int]) -> Column:
    """Each color as the permutation says; what isn't one of 0 to 9 raises."""
    if sorted(permutation) != list(range(COLORS)):
        raise ValueError("not a permutation of the colors")
    table = F.array(*(F.lit(p) for p in permutation))
    return F.transform(g, lambda r: F.transform(r, lambda c: F.element_at(table, c + 1)))


def augment(pairs: Column, name: str, permutation: list[int]) -> Column:
    """An array of ``(input, output)`` with both changed alike."""
    return F.transform(pairs, lambda p: F.struct(recolor(symmetry(p["input"], name), permutation).alias("input"), recolor(symmetry(p["output"], name), permutation).alias("output")))


def run_program(g: Column, program: list[tuple]) -> Column:
    """Steps ``(symmetry,)`` or ``("recolor", from, to)`` one after the other; the empty program changes nothing."""
    for step in program:
        if step[0] == "recolor":
            _, source, target = step
            if not (0 <= source < COLORS and 0 <= target < COLORS):
                raise ValueError("a color is out of range")
            g = F.transform(g, lambda r: F.transform(r, lambda c: F.when(c == source, F.lit(target)).otherwise(c)))
        else:
            g = symmetry(g, step[0])
    return g


def consistent(pairs: Column, program: list[tuple]) -> Column:
    return F.forall(pairs, lambda p: run_program(p["input"], program) == p["output"])


def first_program(pairs: Column, catalogue: list[list[tuple]]) -> Column:
    """Position of the first program that fits every pair; null if none does."""
    return F.coalesce(*(F.when(consistent(pairs, p), F.lit(k)) for k, p in enumerate(catalogue)))


def vote(answers: DataFrame) -> DataFrame:
    """``(task_id, grid)`` of ``(task_id, pos, grid)``: the most frequent whole grid, of those the earliest."""
    counts = answers.groupBy("task_id", "grid").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.groupBy("task_id").agg(F.max_by("grid", F.struct("n", -F.col("first"))).alias("grid"))


def ensemble(tasks: DataFrame, program: list[tuple], names: list[str]) -> DataFrame:
    """``(task_id, grid)``: the program on each symmetry of the input, turned back, and the vote over them."""
    turned = [F.struct(F.lit(k).alias("pos"), symmetry(run_program(symmetry(F.col("grid"), n), program), inverse(n)).alias("grid")) for k, n in enumerate(names)]
    return vote(tasks.select("task_id", F.explode(F.array(*turned)).alias("a")).select("task_id", "a.pos", "a.grid"))


def diversity(tasks: DataFrame) -> DataFrame:
    """One row of exact figures over ``(task, family, input, output)``, grids as arrays."""
    key = lambda c: F.to_json(F.struct(F.col(c).alias("g")))
    shape = F.concat_ws("x", F.size("input"), F.size(F.col("input")[0]))
    rows = tasks.select("family", key("input").alias("i"), key("output").alias("o"), F.concat(key("input"), key("output")).alias("both"), shape.alias("shape"))
    out = rows.agg(F.count("*").alias("n_tasks"), F.countDistinct("family").alias("n_families"), F.countDistinct("i").alias("n_inputs"), F.countDistinct("o").alias("n_outputs"), F.countDistinct("both").alias("n_unique"), F.countDistinct("shape").alias("n_shapes"))
    return out.withColumn("collision_rate", F.when(F.col("n_tasks") > 0, F.round(1 - F.col("n_unique") / F.col("n_tasks"), 6)).otherwise(F.lit(0.0)))


def color_histogram(tasks: DataFrame) -> DataFrame:
    """``(color, n)`` over the cells of the outputs, for all ten colors."""
    cells = tasks.select(F.explode(F.flatten("output")).alias("color")).groupBy("color").agg(F.count("*").alias("n"))
    every = tasks.sparkSession.range(COLORS).select(F.col("id").cast("int").alias("color"))
    return every.join(cells, "color", "left").select("color", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _settings(kind: str, **axes) -> list[dict]:
    return [{"kind": kind, **dict(zip(axes, values))} for values in product(*axes.values())]


def parameter_grid() -> list[dict]:
    """Every family with every setting of its parameters; the first parameter named changes slowest."""
    # Families, names of their parameters and ranges, in this order.
    out = [{"kind": s["kind"], "dx": s["dx"], "dy": s["dy"], "bg": s["bg"]} for s in _settings("translate", bg=range(COLORS), dx=range(-3, 4), dy=range(-3, 4))]
    out += [s for s in _settings("recolor", src=range(COLORS), dst=range(COLORS)) if s["src"] != s["dst"]]
    out += _settings("crop", bg=range(COLORS))
    out += _settings("tile", nx=range(1, 5), ny=range(1, 5))
    out += _settings("gravity", bg=range(COLORS), dir=range(4))
    out += _settings("mirror", dihedral=range(len(SYMMETRIES)))
    out += _settings("scale", factor=[2, 3])
    return out + _settings("border", color=range(COLORS), width=[1, 2])


def family_id(spec: dict) -> str:
    """The kind and the settings in the order of their names."""
    return spec["kind"] + ":" + ",".join(sorted(f"{k}={v}" for k, v in spec.items() if k != "kind"))


_RANGES = {
    "translate": {"dx": range(-(1 << 31), 1 << 31), "dy": range(-(1 << 31), 1 << 31), "bg": range(COLORS)}, "recolor": {"src": range(COLORS), "dst": range(COLORS)}, "crop": {"bg": range(COLORS)},
    "tile": {"nx": range(1, MAX_SIDE + 1), "ny": range(1, MAX_SIDE + 1)}, "gravity": {"dir": range(4), "bg": range(COLORS)}, "mirror": {"dihedral": range(len(SYMMETRIES))},
    "scale": {"factor": range(2, 4)}, "border": {"color": range(COLORS), "width": range(1, 3)},
}


def check_family(spec: dict) -> None:
    """Raises unless the family is known and has exactly its parameters, each in its range."""
    allowed = _RANGES.get(spec.get("kind"))
    if allowed is None or set(spec) - {"kind"} != set(allowed) or any(spec[k] not in r for k, r in allowed.items()) or (spec["kind"] == "recolor" and spec["src"] == spec["dst"]):
        raise ValueError(f"no such family: {spec}")


def _turned(g: list[list[int]], name: str) -> list[list[int]]:
    """One of the eight symmetries of a list of rows, as ``symmetry`` of a Column."""
    down = [list(r) for r in zip(*g)]
    mirrored = {"identity": (g, 1, 1), "rot90": (down, 1, -1), "rot180": (g, -1, -1), "rot270": (down, -1, 1), "flip_h": (g, 1, -1), "flip_v": (g, -1, 1), "transpose": (down, 1, 1), "anti_transpose": (down, -1, -1)}
    rows, up, back = mirrored[name]
    return [r[::back] for r in rows[::up]]


def apply_family(spec: dict, g: list[list[int]]) -> list[list[int]]:
    """The output of a family for one input grid."""
    check_family(spec)
    kind, h, w = spec["kind"], len(g), len(g[0])
    if kind == "translate":
        return [[g[(r - spec["dy"]) % h][(c - spec["dx"]) % w] for c in range(w)] for r in range(h)]
    if kind == "recolor":
        return [[spec["dst"] if c == spec["src"] else c for c in row] for row in g]
    if kind == "crop":
        kept = [(r, c) for r in range(h) for c in range(w) if g[r][c] != spec["bg"]]
        if not kept:
            return [[spec["bg"]]]
        rows, cols = [r for r, _ in kept], [c for _, c in kept]
        return [row[min(cols) : max(cols) + 1] for row in g[min(rows) : max(rows) + 1]]
    if kind == "tile":
        return [row * spec["nx"] for _ in range(spec["ny"]) for row in g]
    if kind == "gravity":
        # 0 is down, 1 up, 2 left, 3 right. What falls up or left comes first.
        lines = [list(x) for x in zip(*g)] if spec["dir"] < 2 else g
        first = spec["dir"] in (1, 2)
        solid = [[c for c in x if c != spec["bg"]] for x in lines]
        fallen = [x + [spec["bg"]] * (len(lines[0]) - len(x)) if first else [spec["bg"]] * (len(lines[0]) - len(x)) + x for x in solid]
        return [list(x) for x in zip(*fallen)] if spec["dir"] < 2 else fallen
    if kind == "mirror":
        return _turned(g, SYMMETRIES[spec["dihedral"]])
    if kind == "scale":
        k = spec["factor"]
        return [[c for c in row for _ in range(k)] for row in g for _ in range(k)]
    k, c = spec["width"], spec["color"]
    edge = [[c] * (w + 2 * k) for _ in range(k)]
    return edge + [[c] * k + row + [c] * k for row in g] + edge


def _most(spec: dict) -> tuple[int, int]:
    """Sides up to which an input is made: its output must be a grid, too."""
    if spec["kind"] == "tile":
        sides = MAX_SIDE // spec["ny"], MAX_SIDE // spec["nx"]
    else:
        both = MAX_SIDE // spec["factor"] if spec["kind"] == "scale" else MAX_SIDE - 2 * spec["width"] if spec["kind"] == "border" else MAX_SIDE
        sides = both, both
    return min(sides[0], MAX_MADE), min(sides[1], MAX_MADE)


def make_task(spec: dict, seed: int, n_train: int = 3) -> list[tuple[list, list]]:
    """Different pairs of a family; the last one is the test. Raises if they aren't found in 10,000 draws."""
    check_family(spec)
    if n_train < 1:
        raise ValueError("a task needs a pair to learn from")
    draw, pairs, seen, (rows, cols) = SplitMix(seed), [], set(), _most(spec)
    for _ in range(10_000):
        h, w = draw.next() % rows + 1, draw.next() % cols + 1
        g = [[draw.next() % COLORS for _ in range(w)] for _ in range(h)]
        if str(g) not in seen:
            seen.add(str(g))
            pairs.append((g, apply_family(spec, g)))
            if len(pairs) > n_train:
                return pairs
    raise ValueError("too few different pairs")


def sample_specs(n: int, seed: int) -> list[dict]:
    """The first n of the whole grid of parameters after a forward exchange; more than there are raise."""
    specs = parameter_grid()
    if not 0 < n <= len(specs):
        raise ValueError(f"not a number of settings: {n}")
    draw = SplitMix(seed)
    for k in range(min(n, len(specs) - 1)):
        other = k + draw.next() % (len(specs) - k)
        specs[k], specs[other] = specs[other], specs[k]
    return specs[:n]


def procedural_tasks(spark: SparkSession, specs: list[dict], n: int, seed: int, n_train: int = 3) -> DataFrame:
    """``(task, pair, family, input, output)`` of n tasks that go through the settings in turn, seeds counted up."""
    grid = "array<array<int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["id"].tolist():
                spec = specs[t % len(specs)]
                out += [(t, k, family_id(spec), i, o) for k, (i, o) in enumerate(make_task(spec, seed + t, n_train))]
            yield pd.DataFrame(out, columns=["task", "pair", "family", "input", "output"])

    return spark.range(n).mapInPandas(run, f"task long, pair int, family string, input {grid}, output {grid}")
