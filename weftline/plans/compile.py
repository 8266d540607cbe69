"""A parsed mapping to a DataFrame plan.

Every arrow becomes one column expression and the mapping one select (or one aggregation), so that the optimiser sees the whole plan. Filters of sources
come before anything else, list filters before their list is exploded. Conditions under which rows go are collected from all arrows and applied once,
on the values at their place in the chain. Prose is never guessed at: an arrow whose chain holds prose without a binding is listed as unresolved and its target is null.

An arrow without a source whose prose is arithmetic of references is computed from target fields: these arrows come after the others, in stages, one select each, so that each takes the finished
values of those it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.steps import AGGREGATES, Context, Value, apply
from weftline.functions.types import field_type
from weftline.lang.names import Workspace
from weftline.lang.syntax import Arrow, Block, Field, unquote
from weftline.plans.formula import NotAFormula, formula, stages
from weftline.plans.predicate import NotAPredicate, predicate

Binding = Callable[[Column], Column] | str


@dataclass
class Compiled:
    """What a mapping gives: its rows, the rows with warnings (a column ``warnings`` names them), and prose that nothing was bound to."""

    rows: DataFrame
    warnings: DataFrame | None
    unresolved: list[str] = field(default_factory=list)


@dataclass
class Options:
    """bindings: expressions for prose and for whole targets (``target:<path>``); join: how several sources become one input, from a dict of
    them; now and zone: of the run; order: what first and last go by in groups; cast: whether targets get their declared types; outer: whether flatten keeps rows of empty lists."""

    bindings: dict[str, Binding] = field(default_factory=dict)
    join: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    now: Column | None = None
    zone: str = "UTC"
    order: Column | None = None
    cast: bool = True
    outer: bool = False


class _Scope:
    """How a source path becomes a column: in the input row, or in an element of a list."""

    def __init__(self, sources: list[str], element: Column | None = None, inside: str = "", outer: _Scope | None = None):
        self.sources, self.element, self.inside, self.outer = sources, element, inside, outer

    def column(self, path: str) -> Column:
        relative = path.startswith(".")
        path = path.lstrip(".")
        if self.element is not None:
            if relative or path.startswith(f"{self.inside}."):
                return _get(self.element, path if relative else path[len(self.inside) + 1 :])
            if self.outer is not None and "." not in path and not relative:
                return self.outer.column(path)
            if self.outer is not None:
                return self.outer.column(path)
        bare = path.split("::")[-1]
        head, _, rest = bare.partition(".")
        return F.col(rest if rest and head in self.sources else bare) if "." in bare else F.col(f"`{bare}`")


def _get(element: Column, path: str) -> Column:
    return reduce(lambda c, name: c[name], path.split("."), element)


def _context(workspace: Workspace, options: Options, grouped: bool) -> Context:
    transforms = {k: b.steps for k, b in workspace.transforms.items()} | {b.name: b.steps for b in workspace.transforms.values() if b.name}
    extra = {} if options.now is None else {"now": options.now}
    return Context(zone=options.zone, order=options.order, transforms=transforms, bindings=dict(options.bindings), grouped=grouped, **extra)


def _is_aggregate(arrow: Arrow) -> bool:
    return any(s.kind == "text" and s.atoms and s.atoms[0] in {("name", a) for a in AGGREGATES} for s in arrow.steps) and not any(
        s.kind == "text" and s.atoms and s.atoms[0][1] == "split" for s in arrow.steps
    )


class _Arrows:
    """Compiles arrows in a scope; collects row conditions, warnings and what is unresolved."""

    def __init__(self, scope: _Scope, context: Context, options: Options, filters: dict[str, str]):
        self.scope, self.context, self.options, self.filters = scope, context, options, filters
        self.drops: list[Column] = []
        self.warnings: list[tuple[str, Column]] = []

    def value(self, arrow: Arrow, scope: _Scope | None = None) -> Column | None:
        """The arrow's column, null if it is unresolved."""
        scope = scope or self.scope
        bound = self.context.bindings.get(f"target:{arrow.target.lstrip('.')}")
        columns = [scope.column(p) for p in arrow.sources]
        if bound is not None:
            start = columns[0] if len(columns) == 1 else F.struct(*columns) if columns else F.lit(None)
            return bound(start) if callable(bound) else F.expr(bound)
        if not arrow.steps and len(columns) == 1:
            return columns[0]
        if not columns and not arrow.steps or len(columns) > 1 and not arrow.steps:
            self.context.unresolved.append(arrow.text)
            return F.lit(None)
        if len(columns) > 1 and not (arrow.steps[0].kind == "text" and arrow.steps[0].atoms[0][1] in ("concat", "coalesce")):
            self.context.unresolved.append(arrow.steps[0].text)
            return F.lit(None)
        steps = arrow.steps
        start = columns[0] if columns else F.lit(None)
        if len(columns) > 1:
            start = F.concat(*columns) if steps[0].atoms[0][1] == "concat" else F.coalesce(*columns)
            steps = steps[1:]
        before = len(self.context.unresolved)
        got = apply(Value(start, F.lit(True)), steps, self.context)
        if got is None:
            if len(self.context.unresolved) == before:
                self.context.unresolved.append(arrow.text)
            return F.lit(None)
        self.drops += got.drops
        self.warnings += [(f"{arrow.target}: {name}", bad) for name, bad in got.warnings]
        return got.column

    def each(self, arrow: Arrow, scope: _Scope, target: Field | None) -> Column:
        """A list of structs, one for each element of the source list that passes its filter."""
        source = arrow.sources[0]
        listed = self.filtered(scope, source)

        def made(element: Column) -> Column:
            inner = _Scope(scope.sources, element, source.lstrip("."), scope)
            return self.struct(arrow.children, inner, target)

        return F.transform(listed, made)

    def filtered(self, scope: _Scope, source: str) -> Column:
        listed, text = scope.column(source), self.filters.get(source.lstrip(".").split("::")[-1])
        return F.filter(listed, lambda e: predicate(text, lambda p: _get(e, p))) if text else listed

    def struct(self, arrows: list[Arrow], scope: _Scope, target: Field | None) -> Column:
        children = {f.name: f for f in target.children} if target else {}
        made: dict[str, Column] = {}
        for a in arrows:
            name = a.target.lstrip(".").split(".")[-1]
            made[name] = self.typed(self.item(a, scope, children.get(name)), children.get(name))
        return F.struct(*(c.alias(n) for n, c in made.items()))

    def item(self, arrow: Arrow, scope: _Scope, target: Field | None) -> Column:
        if arrow.kind == "each":
            return self.each(arrow, scope, target)
        if arrow.kind == "nested":
            inner = _Scope(scope.sources, scope.column(arrow.sources[0]), arrow.sources[0].lstrip("."), scope)
            return self.struct(arrow.children, inner, target)
        return self.value(arrow, scope)

    def typed(self, column: Column, target: Field | None) -> Column:
        """With its declared type, and the declared default in place of nulls."""
        if target is None:
            return column
        if self.options.cast and not target.children and target.type:
            column = column.cast(field_type(target))
        default = next((m.value for m in target.meta if m.key == "default" and m.value is not None), None)
        return column if default is None else F.coalesce(column, F.lit(default).cast(field_type(target)))


def source_input(workspace: Workspace, mapping: Block, inputs: dict[str, DataFrame], options: Options) -> DataFrame:
    """The mapping's sources, each filtered as declared, joined by the binding where there are several."""
    frames: dict[str, DataFrame] = {}
    for s in mapping.sources:
        if s.is_prose:
            continue
        key = workspace.find(s.name, mapping.namespace, workspace.schemas) or s.name
        frame = inputs.get(key, inputs.get(s.name))
        if frame is None:
            raise KeyError(f"no input for source {s.name!r}")
        text = next((m.value for m in s.meta if m.key == "filter"), None)
        frames[s.name] = frame.where(predicate(text, lambda p, s=s: F.col(p.removeprefix(f"{s.name}.")))) if text else frame
    if not frames:
        raise ValueError("the mapping has no source")
    if len(frames) == 1:
        return next(iter(frames.values()))
    if options.join is None:
        raise ValueError("several sources need a join binding: their prose is not executed")
    return options.join(frames)


def _list_filters(workspace: Workspace, mapping: Block) -> dict[str, str]:
    out = {}
    for s in mapping.sources:
        key = workspace.find(s.name, mapping.namespace, workspace.schemas)
        for path, f, _ in workspace.paths(key) if key else ():
            out |= {path: m.value for m in f.meta if m.key == "filter" and m.value and f.is_list}
    return out


def compile_mapping(workspace: Workspace, name: str, inputs: dict[str, DataFrame], options: Options | None = None) -> Compiled:
    """The plan of a mapping. inputs: DataFrames by source schema. Target columns come in declared order; those without an arrow are left out."""
    options = options or Options()
    key = workspace.find_typed(name, workspace.mappings)
    if key is None:
        raise KeyError(f"no mapping {name!r}")
    mapping = workspace.mappings[key]
    rows = source_input(workspace, mapping, inputs, options)
    target_key = workspace.find(mapping.targets[0], mapping.namespace, workspace.schemas) if mapping.targets else None
    target = workspace.fields.get(target_key, []) if target_key else []
    declared = {f.name: f for f in target}
    group_by = next((m.value for m in mapping.meta if m.key == "group_by" and m.value), None)
    flat = [a for a in mapping.arrows if a.kind == "flatten"]
    tops = [a for a in mapping.arrows if a.kind != "flatten"]
    grouped = group_by is not None or any(map(_is_aggregate, tops))
    context = _context(workspace, options, grouped)
    filters = _list_filters(workspace, mapping)
    names = [s.name.split("::")[-1] for s in mapping.sources if not s.is_prose]
    scope = _Scope(names)
    arrows = _Arrows(scope, context, options, filters)
    rows, placed = _flattened(rows, arrows, flat, scope, options.outer)
    if len(flat) == 1:  # arrows outside the block may still name the list's elements
        scope = arrows.scope = _Scope(names, F.col("_element"), flat[0].sources[0].lstrip("."), scope)
    made: dict[str, Column] = {}
    nested: dict[str, dict] = {}
    plain_keys: list[str] = []
    every = [(a, "", scope) for a in tops] + placed
    computed = _computed(workspace, mapping, every, options)
    for a, inside, own in every:
        path = a.target.lstrip(".").split("::")[-1]
        if inside and path.startswith(f"{inside}."):
            path = path[len(inside) + 1 :]
        head, _, rest = path.partition(".")
        if head in computed:
            continue
        if rest:
            at, field = nested.setdefault(head, {}), declared.get(head)
            *between, last = rest.split(".")
            for name in between:
                at, field = at.setdefault(name, {}), _child(field, name)
            field = _child(field, last)
            at[last] = arrows.typed(arrows.item(a, own, field), field)
            continue
        made[head] = arrows.typed(arrows.item(a, own, declared.get(head)), declared.get(head))
        if not _is_aggregate(a):
            plain_keys.append(head)
    for head, parts in nested.items():
        made[head] = _struct(parts, declared.get(head))
        plain_keys.append(head)
    carried = {f"_source{i}": scope.column(r) for i, r in enumerate(sorted({r for c in computed.values() for r in c.from_source}))}
    origin = dict(zip(sorted({r for c in computed.values() for r in c.from_source}), carried, strict=True))
    if grouped and carried:
        raise ValueError(f"fields of a group are computed from target fields, not from rows: {', '.join(origin)}")
    order = [n for n in declared if n in made] + [n for n in made if n not in declared]
    final = [n for n in declared if n in made or n in computed] + [n for n in [*made, *computed] if n not in declared]
    finish = lambda out: _staged(out, computed, origin, declared, arrows, context).select(*final) if computed else out.select(*order)
    warned = None
    if grouped:
        # what a step says of source rows counts before they are grouped, and what it says of an aggregate after it
        drops, having = _split_conditions(rows, arrows.drops)
        bad_rows, bad_groups = _split_conditions(rows, [bad for _, bad in arrows.warnings])
        said = [(text, bad) for text, bad in arrows.warnings if any(bad is b for b in bad_rows)]
        if said:
            warned = rows.select("*", _said(said)).where(F.size("warnings") > 0)
        rows = _without(rows, drops)
        late = {f"_late{i}": c for i, c in enumerate([*having, *bad_groups])}
        extra = [c.alias(n) for n, c in late.items()]
        keys = [k.strip() for k in group_by.split(",")] if group_by else []
        if not keys:  # without a token: the arrows that don't aggregate are the keys
            keyed = [made[n].alias(n) for n in plain_keys]
            out = rows.groupBy(*keyed).agg(*(made[n].alias(n) for n in order if n not in plain_keys), *extra) if len(plain_keys) < len(order) or extra else rows.select(*keyed).distinct()
        else:
            source_keys = [scope.column(k).alias(f"_key{i}") for i, k in enumerate(keys)]  # a target may have a key's name
            of = (lambda c: F.min(c)) if options.order is None else (lambda c: F.min_by(c, options.order))
            lifted = {n: (of(made[n]) if n in plain_keys else made[n]) for n in order}  # whatever order rows come in
            out = rows.groupBy(*source_keys).agg(*(c.alias(n) for n, c in lifted.items()), *extra)
        texts = [text for text, bad in arrows.warnings if any(bad is b for b in bad_groups)]
        if texts:
            groups = out.select(*order, _said([(t, F.col(n)) for t, n in zip(texts, list(late)[len(having) :], strict=True)])).where(F.size("warnings") > 0)
            warned = groups if warned is None else warned.unionByName(groups, allowMissingColumns=True)
        return Compiled(finish(_without(out, [F.col(n) for n in list(late)[: len(having)]])), warned, context.unresolved)
    if arrows.warnings:
        warned = rows.select(*(made[n].alias(n) for n in order), _said(arrows.warnings)).where(F.size("warnings") > 0)
    rows = _without(rows, arrows.drops)
    return Compiled(finish(rows.select(*(made[n].alias(n) for n in order), *(c.alias(n) for n, c in carried.items()))), warned, context.unresolved)


def _flattened(rows: DataFrame, arrows: _Arrows, flats: list[Arrow], scope: _Scope, outer: bool) -> tuple[DataFrame, list[tuple[Arrow, str, _Scope]]]:
    """rows with an element of each list, and (arrow, its block's target, its scope) for what the blocks hold.

    Lists of several blocks beside each other are aligned by position: one explode of as many places as the longest has, and nulls where a list has ended; never their product. A block inside
    a block explodes a list of the element, after it. Rows without any element are dropped, or kept with nulls (outer).
    """
    placed: list[tuple[Arrow, str, _Scope]] = []
    explode = F.explode_outer if outer else F.explode
    level, depth = [(f, f.target.lstrip("."), scope) for f in flats], 0
    while level:
        name = "_element" if depth == 0 else f"_element{depth}"
        lists = [arrows.filtered(s, f.sources[0]) for f, _, s in level]
        if len(level) == 1:
            rows, elements = rows.select("*", explode(lists[0]).alias(name)), [F.col(name)]
        else:
            most = F.greatest(*(F.coalesce(F.size(x), F.lit(0)) for x in lists))
            places = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
            aligned = F.transform(places, lambda i: F.struct(*(F.get(x, i).alias(f"e{k}") for k, x in enumerate(lists))))
            rows, elements = rows.select("*", explode(aligned).alias(name)), [F.col(name)[f"e{k}"] for k in range(len(level))]
        below = []
        for (f, inside, s), element in zip(level, elements, strict=True):
            own = _Scope(s.sources, element, f.sources[0].lstrip("."), s)
            placed += [(c, inside, own) for c in f.children if c.kind != "flatten"]
            below += [(c, c.target.lstrip("."), own) for c in f.children if c.kind == "flatten"]
        level, depth = below, depth + 1
    return rows, placed


@dataclass
class _Computed:
    """An arrow on target fields: what it needs of them and of the sources, how they make its column, and the steps after that."""

    arrow: Arrow
    needs: set[str]
    from_source: set[str]
    column: Callable[[Callable[[str], Column]], Column]


def _computed(workspace: Workspace, mapping: Block, every: list[tuple[Arrow, str, _Scope]], options: Options) -> dict[str, _Computed]:
    """The arrows without a source whose first step is arithmetic of references, each to a target field of the mapping or a field of its sources."""
    targets = {a.target.lstrip(".").split("::")[-1].split(".")[-1 if inside else 0] for a, inside, _ in every}
    out = {}
    for a, _, _ in every:
        name = a.target.lstrip(".").split("::")[-1]
        bound = options.bindings.get(f"target:{name}")
        text = a.steps[0].text if a.steps and a.steps[0].kind == "text" else ""
        if a.sources or bound is not None or not text or options.bindings.get(text) or options.bindings.get(unquote(text)):
            continue
        try:
            said = formula(unquote(text))
        except NotAFormula:
            continue
        of_source = {r for r in said.refs if r not in targets}
        if all(_in_sources(workspace, mapping, r) for r in of_source):
            out[name] = _Computed(a, set(said.refs) - of_source, of_source, said.column)
    return out


def _in_sources(workspace: Workspace, mapping: Block, ref: str) -> bool:
    for s in mapping.sources:
        key = None if s.is_prose else workspace.find(s.name, mapping.namespace, workspace.schemas)
        if key and any(path in (ref, ref.split("::")[-1].partition(".")[2]) for path, _, _ in workspace.paths(key)):
            return True
    return False


def _staged(out: DataFrame, computed: dict[str, _Computed], origin: dict[str, str], declared: dict[str, Field], arrows: _Arrows, context: Context) -> DataFrame:
    """out with its computed fields, a select for each stage."""
    plain = replace(context, grouped=False)
    for names in stages({n: c.needs for n, c in computed.items()}):
        made = {}
        for n in names:
            one = computed[n]
            got = apply(Value(one.column(lambda r: F.col(f"`{origin.get(r, r)}`")), F.lit(True)), one.arrow.steps[1:], plain)
            made[n] = arrows.typed(F.lit(None) if got is None else got.column, declared.get(n))
        out = out.withColumns(made)
    return out


def _child(field: Field | None, name: str) -> Field | None:
    return next((f for f in field.children if f.name == name), None) if field else None


def _struct(parts: dict, field: Field | None) -> Column:
    """Columns by name, and by name again below one, as structs; declared fields come first, in their order."""
    declared = [f.name for f in field.children] if field else []
    names = [n for n in declared if n in parts] + [n for n in parts if n not in declared]
    return F.struct(*((_struct(parts[n], _child(field, n)) if isinstance(parts[n], dict) else parts[n]).alias(n) for n in names))


def _split_conditions(rows: DataFrame, conditions: list[Column]) -> tuple[list[Column], list[Column]]:
    """Conditions on single rows, and those on aggregates, which no row can be asked."""
    single, grouped = [], []
    for c in conditions:
        try:
            rows.where(c)
            single.append(c)
        except AnalysisException:
            grouped.append(c)
    return single, grouped


def _said(warnings: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for text, bad in warnings))).alias("warnings")


def _without(rows: DataFrame, drops: list[Column]) -> DataFrame:
    return rows.where(~reduce(lambda a, b: a | b, (F.coalesce(d, F.lit(False)) for d in drops))) if drops else rows


def compile_target(workspace: Workspace, target: str, inputs: dict[str, DataFrame], options: Options | None = None) -> Compiled:
    """All mappings into one target, one after another: a union of all their rows by name."""
    parts = [compile_mapping(workspace, k, inputs, options) for k, m in workspace.mappings.items() if target in m.targets]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.rows for p in parts))
    warned = [p.warnings for p in parts if p.warnings is not None]
    told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), warned) if warned else None
    return Compiled(rows, told, [u for p in parts for u in p.unresolved])


def compile_metric(workspace: Workspace, metric: str, fact: DataFrame, time: str | None = None, slices: list[str] | None = None, components: dict[str, str] | None = None) -> DataFrame:
    """A metric's measures by its grain and slices (or a subset of them), after its filter.

    Additive measures are summed. Semi-additive ones are summed over everything but time, and of the times in a grain the last counts. Non-additive ones are
    recomputed from components, an expression for each; without one they raise an error.
    """
    key = workspace.find_typed(metric, workspace.schemas)
    schema = workspace.schemas[key]
    condition = schema.value("filter")
    if condition:
        fact = fact.where(predicate(condition))
    cut = slices if slices is not None else next((m.values for m in schema.meta if m.kind == "slice"), [])
    grain = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}.get(schema.value("grain") or "", schema.value("grain"))
    by = [F.col(c) for c in cut]
    if grain and time:
        by.append(F.date_trunc(grain, F.col(time)).cast("date").alias(grain))
    kinds = {f.name: m.value or "additive" if m.kind == "kv" else "additive" for f in workspace.fields[key] for m in f.meta if m.key == "measure"}
    made, at_last = [], []
    for name, kind in kinds.items():
        if kind == "non_additive":
            if name not in (components or {}):
                raise ValueError(f"{name} is not additive: give its expression over the facts")
            made.append(F.expr(components[name]).alias(name))
        elif kind == "semi_additive":
            at_last.append(name)
        else:
            made.append(F.sum(name).alias(name))
    if not at_last:
        return fact.groupBy(*by).agg(*made)
    # first over everything but time, then the last time of each grain
    levels = fact.groupBy(*cut, time).agg(*(F.sum(n).alias(n) for n in at_last)).groupBy(*by).agg(*(F.max_by(n, F.col(time)).alias(n) for n in at_last))
    if not made:
        return levels
    names = [*cut, *([grain] if grain and time else [])]
    sums = fact.groupBy(*by).agg(*made).alias("s")
    levels = levels.alias("l")
    same = reduce(lambda a, b: a & b, (F.col(f"s.{n}").eqNullSafe(F.col(f"l.{n}")) for n in names), F.lit(True))
    return sums.join(levels, same).select(*(F.col(f"s.{n}") for n in names), *(F.col(f"{'l' if n in at_last else 's'}.{n}") for n in kinds))


__all__ = ["Compiled", "NotAPredicate", "Options", "compile_mapping", "compile_metric", "compile_target", "source_input"]
