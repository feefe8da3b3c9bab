"""The graph of foreign keys, and how restrictions travel along it.

cascade: downwards, where paths meet an entity is affected if any path affects it. restrict: downwards, it stays if all paths
keep it. trace: upwards, an entity counts if any path leads to it. Each step is a semijoin on the foreign key, or a copy of the
condition where its attributes are in the child's key under the same names.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from ..errors import IntegrityError, KeyloomError
from ..operators.relation import Relation
from ..operators.restriction import AndList

if TYPE_CHECKING:
    from ..sources.catalog import Catalog


@dataclass(frozen=True)
class Edge:
    parent: str
    child: str
    columns: tuple[tuple[str, str], ...]  # child attribute, parent attribute
    primary: bool

    @property
    def renamed(self) -> bool:
        return any(c != p for c, p in self.columns)


class Graph:
    """A set of tables with all foreign keys among them; +, - and * are set operations on its tables."""

    def __init__(self, catalog: Catalog, tables: Iterable[str] | None = None):
        self.catalog = catalog
        self.every = [Edge(f.parent, t, tuple(f.columns.items()), f.primary) for t in catalog.tables() for f in catalog.definition(t).foreign_keys]
        self.tables = set(catalog.tables() if tables is None else tables)

    @classmethod
    def from_sequence(cls, graphs: Iterable[Graph]) -> Graph:
        """The union of several graphs."""
        found = list(graphs)
        if not found:
            raise KeyloomError("a graph needs at least one")
        out = found[0]
        for g in found[1:]:
            out = out + g
        return out

    def _with(self, tables: Iterable[str]) -> Graph:
        return Graph(self.catalog, tables)

    @property
    def edges(self) -> list[Edge]:
        return [e for e in self.every if e.parent in self.tables and e.child in self.tables]

    def parents(self, table: str, primary: bool | None = None) -> list[str]:
        return list(dict.fromkeys(e.parent for e in self.every if e.child == table and primary in (None, e.primary)))

    def children(self, table: str, primary: bool | None = None) -> list[str]:
        return list(dict.fromkeys(e.child for e in self.every if e.parent == table and primary in (None, e.primary)))

    def _reach(self, table: str, step: Any) -> set[str]:
        seen, todo = {table}, [table]
        while todo:
            for t in step(todo.pop()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def ancestors(self, table: str) -> list[str]:
        return [t for t in self.sorted() if t in self._reach(table, self.parents)]

    def descendants(self, table: str) -> list[str]:
        return [t for t in self.sorted() if t in self._reach(table, self.children)]

    def master(self, table: str) -> str | None:
        return self.catalog.info(table)["master"]

    def parts(self, table: str) -> list[str]:
        return [t for t in self.sorted() if self.master(t) == table]

    def sorted(self) -> list[str]:
        """Parents before children; parts directly after their master where dependencies allow."""
        names = self.catalog.tables()
        before: dict[str, set[str]] = {t: {e.parent for e in self.every if e.child == t and e.parent != t} for t in names}
        for t in names:  # a master waits for what its parts depend on
            m = self.master(t)
            if m in before:
                before[m] |= {p for p in before[t] if p != m and self.master(p) != m and m not in self._reach(p, self.parents)}
        out: list[str] = []
        while len(out) < len(names):
            ready = [t for t in names if t not in out and before[t] <= set(out)]
            if not ready:
                raise KeyloomError(f"foreign keys form a cycle among {sorted(set(names) - set(out))}")
            own = [t for t in ready if self.master(t) and out and self.master(t) in (out[-1], self.master(out[-1]))]
            out.append((own or ready)[0])
        return out

    # ---- set algebra

    def __add__(self, other: Graph | int) -> Graph:
        """Union, or with a number so many steps down."""
        if isinstance(other, Graph):
            return self._with(self.tables | other.tables)
        found = set(self.tables)
        for _ in range(other):
            found |= {e.child for e in self.every if e.parent in found}
        return self._with(found)

    def __sub__(self, other: Graph | int) -> Graph:
        """Difference, or with a number so many steps up."""
        if isinstance(other, Graph):
            return self._with(self.tables - other.tables)
        found = set(self.tables)
        for _ in range(other):
            found |= {e.parent for e in self.every if e.child in found}
        return self._with(found)

    def __mul__(self, other: Graph) -> Graph:
        return self._with(self.tables & other.tables)

    def add_parts(self) -> Graph:
        return self._with(self.tables | {t for t in self.catalog.tables() if self.master(t) in self.tables})

    def topological(self) -> list[str]:
        return [t for t in self.sorted() if t in self.tables]

    # ---- propagation

    def _down(self, edge: Edge, parent: Relation) -> Relation:
        """The parent's entities by the child's names of the foreign key."""
        return parent.proj(**{c: p for c, p in edge.columns if c != p}) if edge.renamed else parent.proj()

    def _up(self, edge: Edge, child: Relation) -> Relation:
        """The child's references by the parent's names."""
        keyed = child.proj(*[c for c, _ in edge.columns if c not in child.primary_key])
        from ..operators.relation import U

        got = U(*[c for c, _ in edge.columns]) & keyed
        return got.proj(**{p: c for c, p in edge.columns if c != p}) if edge.renamed else got

    def _spread(self, table: str, seed: Relation | Mapping, meet: str) -> Restricted:
        condition = dict(seed) if isinstance(seed, Mapping) else None
        first = self.catalog.relation(table) & condition if condition is not None else seed
        found: dict[str, Relation] = {table: first}
        copied: dict[str, dict | None] = {table: condition}
        for t in self.descendants(table):
            edges = [e for e in self.every if e.child == t and e.parent in found and e.parent != t]
            if t == table or not edges:
                continue
            base = self.catalog.relation(t)
            terms: list[Any] = []
            for e in edges:
                c = copied.get(e.parent)
                same = c is not None and not e.renamed and all(n in base.primary_key and (n, n) in e.columns for n in c)
                copied[t] = c if same and len(edges) == 1 else None
                terms.append(c if same else self._down(e, found[e.parent]))
            # the foreign key guarantees one origin, whatever the names
            found[t] = base.restrict(terms[0] if len(terms) == 1 else AndList(terms) if meet == "and" else terms, semantic_check=False)
        return Restricted(self, found)

    def cascade(self, table: str, seed: Relation | Mapping, part_integrity: str = "enforce") -> Restricted:
        """What a deletion of seed's entities affects. part_integrity: enforce refuses parts whose master stays, ignore takes
        them, cascade takes their masters too."""
        found = self._spread(table, seed, "or")
        if part_integrity not in {"enforce", "ignore", "cascade"}:
            raise KeyloomError(f"unknown part_integrity {part_integrity!r}")
        if part_integrity == "cascade":
            while True:
                lone = [t for t in found.relations if self.master(t) and self.master(t) not in found.relations]
                if not lone:
                    break
                part = lone[0]
                master = self.master(part)
                up = self._chain_up(part, master, found.relations[part])
                more = self._spread(master, self.catalog.relation(master).restrict(up, semantic_check=False), "or")
                joint = dict(found.relations)
                for t, r in more.relations.items():
                    joint[t] = self.catalog.relation(t).restrict([joint[t].proj(), r.proj()], semantic_check=False) if t in joint else r
                found = Restricted(self, joint)
        elif part_integrity == "enforce":
            for t, r in found.relations.items():
                m = self.master(t)
                if m and m not in found.relations and r:
                    raise IntegrityError(f"{t} can't lose entities while its master {m} keeps its own")
        return found

    def _chain_up(self, part: str, master: str, relation: Relation) -> Relation:
        """The master's entities that a part's belong to, through parts of parts if need be."""
        at, now = part, relation
        while at != master:
            edge = next((e for e in self.every if e.child == at and e.parent == master), None) or next(e for e in self.every if e.child == at and master in self._reach(e.parent, self.parents))
            now, at = self.catalog.relation(edge.parent).restrict(self._up(edge, now), semantic_check=False), edge.parent
        return now.proj()

    def restrict(self, table: str, seed: Relation | Mapping) -> Restricted:
        return self._spread(table, seed, "and")

    def trace(self, table: str, seed: Relation | Mapping) -> Restricted:
        """What seed's entities depend on."""
        found = {table: self.catalog.relation(table) & seed if isinstance(seed, Mapping) else seed}
        for t in reversed(self.ancestors(table)):
            edges = [e for e in self.every if e.parent == t and e.child in found and e.child != t]
            if t != table and edges:
                found[t] = self.catalog.relation(t).restrict([self._up(e, found[e.child]) for e in edges], semantic_check=False)
        return Restricted(self, found)

    def mermaid(self, collapse: bool = False) -> str:
        """The graph as text for a flowchart; with collapse, a node for each namespace."""
        if collapse:
            spaces = list(dict.fromkeys(t.split(".")[0] for t in self.topological()))
            links = dict.fromkeys((e.parent.split(".")[0], e.child.split(".")[0]) for e in self.edges)
            return "\n".join(["flowchart TB", *(f"  {n}[{n}]" for n in spaces), *(f"  {a} --> {b}" for a, b in links if a != b)])
        names = {t: f"n{k}" for k, t in enumerate(self.topological())}
        shapes = {"manual": "[{}]", "lookup": "[/{}/]", "imported": "({})", "computed": "(({}))", "part": "[[{}]]", "job": "[{}]"}
        lines = [f"  {names[t]}{shapes[self.catalog.tier(t)].format(t)}" for t in names]
        arrow = lambda e: "-. renamed .->" if e.renamed else "-->" if e.primary else "-.->"
        return "\n".join(["flowchart TB", *lines, *(f"  {names[e.parent]} {arrow(e)} {names[e.child]}" for e in self.edges)])


class Restricted:
    """Tables with a restriction each."""

    def __init__(self, graph: Graph, relations: dict[str, Relation]):
        self.graph, self.relations = graph, relations

    def __getitem__(self, table: Any) -> Relation:
        name = getattr(table, "full_name", table)
        if name not in self.relations:
            raise KeyloomError(f"{name} isn't reached")
        return self.relations[name]

    def __contains__(self, table: Any) -> bool:
        return getattr(table, "full_name", table) in self.relations

    def __iter__(self):
        return iter(t for t in self.graph.sorted() if t in self.relations)

    def counts(self) -> dict[str, int]:
        return {t: len(self.relations[t]) for t in self}

    def prune(self) -> Restricted:
        """Without tables that have no entity left."""
        return Restricted(self.graph, {t: r for t, r in self.relations.items() if r})
