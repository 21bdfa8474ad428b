"""A planar road graph and its growth from centres: proposals in order of time, each checked against what is there."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from loomgrid.kernel.draws import Stream
from loomgrid.kernel.plane import Point, area, cross_at, foot, snap, turn

VIRTUAL = ("boundary", "shore")
CELL = 32.0


@dataclass
class Edge:
    a: int
    b: int
    cls: str
    width: float = 0.0
    road: int = -1
    bridge: bool = False
    removed: bool = False


class Sheet:
    """Nodes and edges with a grid over both."""

    def __init__(self):
        self.nodes: list[Point] = []
        self.edges: list[Edge] = []
        self.at: list[list[int]] = []
        self._nodes, self._edges = defaultdict(list), defaultdict(list)

    def node(self, x: float, z: float) -> int:
        self.nodes.append((x, z))
        self.at.append([])
        self._nodes[int(x // CELL), int(z // CELL)].append(len(self.nodes) - 1)
        return len(self.nodes) - 1

    def _cells(self, p: Point, q: Point, pad: float = 0.0):
        for cx in range(int((min(p[0], q[0]) - pad) // CELL), int((max(p[0], q[0]) + pad) // CELL) + 1):
            for cz in range(int((min(p[1], q[1]) - pad) // CELL), int((max(p[1], q[1]) + pad) // CELL) + 1):
                yield cx, cz

    def join(self, a: int, b: int, cls: str, **more) -> int:
        k = len(self.edges)
        self.edges.append(Edge(a, b, cls, **more))
        self.at[a].append(k)
        self.at[b].append(k)
        for cell in self._cells(self.nodes[a], self.nodes[b]):
            self._edges[cell].append(k)
        return k

    def split(self, k: int, x: float, z: float) -> int:
        e = self.edges[k]
        e.removed = True
        self.at[e.a].remove(k)
        self.at[e.b].remove(k)
        n = self.node(x, z)
        for p, q in ((e.a, n), (n, e.b)):
            self.join(p, q, e.cls, width=e.width, road=e.road, bridge=e.bridge)
        return n

    def point(self, x: float, z: float) -> int:
        """The node at a place; a new one cuts the edges it lies on."""
        for n in self.nodes_near((x, z), (x, z), 0.01):
            if math.dist(self.nodes[n], (x, z)) < 1e-9:
                return n
        n = None
        for k in self.edges_near((x, z), (x, z), 0.2):
            if foot((x, z), *self.ends(k))[0] <= 0.125 + 1e-9:
                if n is None:
                    n = self.split(k, x, z)
                else:
                    self.bend(k, n)
        return self.node(x, z) if n is None else n

    def bend(self, k: int, n: int) -> None:
        """Leads an edge through a node."""
        e = self.edges[k]
        e.removed = True
        self.at[e.a].remove(k)
        self.at[e.b].remove(k)
        for p, q in ((e.a, n), (n, e.b)):
            if p != q and not any(q in (self.edges[j].a, self.edges[j].b) for j in self.at[p]):
                self.join(p, q, e.cls, width=e.width, road=e.road, bridge=e.bridge)

    def weave(self, a: int, b: int, cls: str, **more) -> None:
        """An edge from a to b, cut where it meets others; parts that are there already stay as they are."""
        p, q = self.nodes[a], self.nodes[b]
        on = {a: 0.0, b: 1.0}
        for k in self.edges_near(p, q, 0.2):
            hit = cross_at(p, q, *self.ends(k))
            if hit:
                x = (snap(p[0] + (q[0] - p[0]) * hit[0]), snap(p[1] + (q[1] - p[1]) * hit[0]))
                n = next((n for n in (self.edges[k].a, self.edges[k].b, a, b) if math.dist(self.nodes[n], x) < 1e-9), None)
                if n is None:
                    n = self.split(k, *x)
                elif n not in (self.edges[k].a, self.edges[k].b):
                    self.bend(k, n)
                on.setdefault(n, hit[0])
        for n in self.nodes_near(p, q, 0.2):
            d, t = foot(self.nodes[n], p, q)
            if d <= 0.125 + 1e-9:
                on.setdefault(n, t)
        chain = sorted(on, key=lambda n: (on[n], n))
        for m, n in zip(chain, chain[1:], strict=False):
            if m != n and not any(n in (self.edges[k].a, self.edges[k].b) for k in self.at[m]):
                self.join(m, n, cls, **more)

    def parts(self) -> int:
        """Connected components of the roads."""
        live, seen, count = set(self.live()), set(), 0
        for k in sorted(live):
            if k in seen:
                continue
            count += 1
            todo = [k]
            seen.add(k)
            while todo:
                e = self.edges[todo.pop()]
                for j in (j for n in (e.a, e.b) for j in self.at[n] if j in live and j not in seen):
                    seen.add(j)
                    todo.append(j)
        return count

    def ends(self, k: int) -> tuple[Point, Point]:
        return self.nodes[self.edges[k].a], self.nodes[self.edges[k].b]

    def edges_near(self, p: Point, q: Point, pad: float) -> list[int]:
        return sorted({k for c in self._cells(p, q, pad) for k in self._edges.get(c, ()) if not self.edges[k].removed})

    def nodes_near(self, p: Point, q: Point, pad: float) -> list[int]:
        return sorted({n for c in self._cells(p, q, pad) for n in self._nodes.get(c, ())})

    def heading(self, n: int, k: int) -> float:
        e = self.edges[k]
        p, q = self.nodes[n], self.nodes[e.b if e.a == n else e.a]
        return math.atan2(q[1] - p[1], q[0] - p[0])

    def live(self) -> list[int]:
        return [k for k, e in enumerate(self.edges) if not e.removed and e.cls not in VIRTUAL]


@dataclass(order=True)
class Proposal:
    time: float
    order: int
    start: int = field(compare=False)
    heading: float = field(compare=False)
    length: float = field(compare=False)
    cls: str = field(compare=False)
    depth: int = field(compare=False)
    road: int = field(compare=False)
    free: bool = field(compare=False, default=False)


class Growth:
    """Streets from the centres outwards, until the budget of edges is used up or nothing is left to try."""

    def __init__(self, rng: Stream, rules: dict, budget: int, centers: list[Point], shores: list, wet: Callable, depth: Callable, height: Callable, heading: Callable, people: Callable, kept: Callable, size: float = 900.0):
        self.rng, self.rules, self.budget, self.half = rng, rules, budget, size / 2
        self.wet, self.depth_of, self.height, self.field, self.people, self.kept = wet, depth, height, heading, people, kept
        self.sheet, self.queue, self.roads, self.built, self.order = Sheet(), [], 0, 0, 0
        self.stats = {"proposals": 0, "rejected": 0, "rejected_grade": 0, "rejected_water": 0, "bridges": 0}
        h = self.half
        corners = [self.sheet.node(*p) for p in ((-h, -h), (h, -h), (h, h), (-h, h))]
        self.frame(corners, True, "boundary")
        known = dict(zip(self.sheet.nodes, corners, strict=True))
        for points, closed in shores:
            ids = [known[p] if p in known else known.setdefault(p, self.sheet.node(*p)) for p in points]
            self.frame(ids, closed, "shore")
        for k, c in enumerate(centers):
            n = self.sheet.node(snap(c[0]), snap(c[1]))
            major = self.field(*c)
            for q in range(4):
                self.propose(2.0 * k, n, major + q * math.pi / 2, "arterial", 0, None)
            for q in range(rules["diagonals"] if not k else 0):
                a = major + math.pi / 4 + q * math.pi / 2 + rng.between(-0.2, 0.2)
                for back in (0.0, math.pi):
                    self.propose(0.0, n, a + back, "arterial", 0, None, free=True)

    def frame(self, ids: list[int], closed: bool, cls: str) -> None:
        """Virtual edges; where they cross older ones, both are cut."""
        for a, b in zip(ids, ids[1:] + ids[:1] if closed else ids[1:], strict=False):
            cuts = []
            for k in list(self.sheet.edges_near(self.sheet.nodes[a], self.sheet.nodes[b], 0.5)):
                e = self.sheet.edges[k]
                if e.cls == cls or {e.a, e.b} & {a, b}:
                    continue
                hit = cross_at(self.sheet.nodes[a], self.sheet.nodes[b], *self.sheet.ends(k))
                if hit:
                    p, q = self.sheet.ends(k)
                    x, z = p[0] + (q[0] - p[0]) * hit[1], p[1] + (q[1] - p[1]) * hit[1]
                    touching = next((n for n in (a, b) if math.dist(self.sheet.nodes[n], (x, z)) < 1e-6), None)
                    if touching is not None:
                        self._through(k, touching)
                    else:
                        cuts.append((hit[0], self.sheet.split(k, x, z)))
            chain = [a, *(n for _, n in sorted(cuts)), b]
            for p, q in zip(chain, chain[1:], strict=False):
                self.sheet.join(p, q, cls)

    def _through(self, k: int, n: int) -> None:
        e = self.sheet.edges[k]
        e.removed = True
        self.sheet.at[e.a].remove(k)
        self.sheet.at[e.b].remove(k)
        for p, q in ((e.a, n), (n, e.b)):
            self.sheet.join(p, q, e.cls, width=e.width, road=e.road, bridge=e.bridge)

    def propose(self, time: float, start: int, heading: float, cls: str, depth: int, road: int | None, free: bool = False) -> None:
        if road is None:
            road, self.roads = self.roads, self.roads + 1
        x, z = self.sheet.nodes[start]
        along = round(turn(heading, self.field(x, z)) / (math.pi / 2)) % 2 == 0
        base = self.rules["spacing"][0 if along else 1] * self.rules["length"][cls]
        length = base * (1.2 - 0.4 * self.people(x, z)) * self.rng.between(0.92, 1.08) if not free else base
        self.order += 1
        heapq.heappush(self.queue, Proposal(time, self.order, start, heading, length, cls, depth, road, free))

    def steepness(self, p: Point, q: Point) -> float:
        run = math.dist(p, q)
        n = max(1, math.ceil(run / 4))
        heights = [self.height(p[0] + (q[0] - p[0]) * k / n, p[1] + (q[1] - p[1]) * k / n) for k in range(n + 1)]
        return max(abs(b - a) for a, b in zip(heights, heights[1:], strict=False)) / (run / n) if run else 0.0

    def banks(self, p: Point, heading: float, length: float) -> tuple[float | None, float | None]:
        """Where a ray enters water, and where it leaves it again within the longest bridge."""
        enter = t = None
        at = lambda t: self.depth_of(p[0] + math.cos(heading) * t, p[1] + math.sin(heading) * t)
        t, before = 0.0, at(0.0)
        while t < length + (self.rules["bridge_span"] if enter is not None else 0):
            t += 3.0
            now = at(t)
            if (now < 0) != (before < 0):
                zero = t - 3.0 * abs(now) / (abs(now) + abs(before) or 1)
                if enter is None and now < 0:
                    if zero > length:
                        return None, None
                    enter = zero
                elif enter is not None and now >= 0:
                    return enter, zero
            before = now
        return enter, None

    def lay(self, start: int, end: Point, cls: str, road: int, bridge: bool = False) -> tuple[int, str] | str:
        """Builds an edge towards end, as far as what is there lets it: (node, how) or the reason why not."""
        s, r = self.sheet, self.rules
        p = s.nodes[start]
        near = min(((foot(end, *s.ends(k)), k) for k in s.edges_near(end, end, r["extend"]) if start not in (s.edges[k].a, s.edges[k].b)), default=None)
        if near and near[0][0] < r["extend"]:
            a, b = s.ends(near[1])
            x = (a[0] + (b[0] - a[0]) * near[0][1], a[1] + (b[1] - a[1]) * near[0][1])
            d = math.dist(p, x) or 1.0
            end = (x[0] + (x[0] - p[0]) / d * 0.6, x[1] + (x[1] - p[1]) / d * 0.6)
        events = [(t, 0, n) for n in s.nodes_near(p, end, r["snap"]) if n != start for d, t in (foot(s.nodes[n], p, end),) if d <= r["snap"]]
        for k in s.edges_near(p, end, 1.0):
            if start not in (s.edges[k].a, s.edges[k].b) and (hit := cross_at(p, end, *s.ends(k))):
                events.append((hit[0], 1, k))
        target, halved = None, None
        if events:
            t, kind, k = min(events)
            if kind == 0:
                target = k
            else:
                x = (p[0] + (end[0] - p[0]) * t, p[1] + (end[1] - p[1]) * t)
                target = next((n for n in (s.edges[k].a, s.edges[k].b) if math.dist(s.nodes[n], x) <= r["snap"]), None)
                if target is None:
                    halved, end = k, (snap(x[0]), snap(x[1]))
        else:
            end = (snap(end[0]), snap(end[1]))
        if target is not None:
            end = s.nodes[target]
        if not bridge and self.wet(*end):
            return "water"
        if halved is not None and self.wet(*end) and s.edges[halved].cls not in VIRTUAL:
            return "water"
        if target is None and (max(abs(end[0]), abs(end[1])) > self.half or self.kept(*end)):
            return "bounds"
        long = math.dist(p, end)
        if long < r["shortest"] * (0.4 if target is not None else 1) or (target is not None and any(start in (s.edges[k].a, s.edges[k].b) for k in s.at[target])):
            return "short"
        if not bridge:
            pieces = [(p, end, cls)]
            if halved is not None and not s.edges[halved].bridge and s.edges[halved].cls not in VIRTUAL:
                a, b = s.ends(halved)
                pieces += [(a, end, s.edges[halved].cls), (end, b, s.edges[halved].cls)]
            if any(self.steepness(a, b) > r["grade"][c] + 1e-12 for a, b, c in pieces):
                return "grade"
        out = math.atan2(end[1] - p[1], end[0] - p[0])
        for n, h in ((start, out), (target, out + math.pi)):
            if n is not None and any(abs(turn(s.heading(n, k), h)) < r["angle"] for k in s.at[n]):
                return "angle"
        if halved is not None:
            own = s.heading(s.edges[halved].a, halved)
            if min(abs(turn(own, out)), abs(turn(own + math.pi, out))) < r["angle"]:
                return "angle"
        for k in s.edges_near(p, end, r["gap"]):
            e = s.edges[k]
            if k == halved or {e.a, e.b} & {start, target}:
                continue
            a, b = s.ends(k)
            if cross_at(p, end, a, b, 1e-6):
                return "crossing"
            if e.cls in VIRTUAL:
                continue
            lie = math.atan2(b[1] - a[1], b[0] - a[0])
            gap = r["gap"] if min(abs(turn(lie, out)), abs(turn(lie + math.pi, out))) < 0.45 else r["snap"]
            if any(foot((p[0] + (end[0] - p[0]) * t, p[1] + (end[1] - p[1]) * t), a, b)[0] < gap for t in (0.25, 0.5, 0.75)):
                return "close"
        if any(n not in (start, target) and foot(s.nodes[n], p, end)[0] < r["snap"] for n in s.nodes_near(p, end, r["snap"])):
            return "close"
        how = "joined" if target is not None else "free"
        if target is None:
            if halved is not None:
                how = s.edges[halved].cls if s.edges[halved].cls in VIRTUAL else "crossed"
                target = s.split(halved, *end)
            else:
                target = s.node(*end)
        s.join(start, target, cls, width=r["widths"][cls], road=road, bridge=bridge)
        self.built += 1
        self.stats["bridges"] += bridge
        return target, how

    def branch(self, p: Proposal, n: int, heading: float, how: str) -> None:
        r, rng = self.rules, self.rng
        if how in VIRTUAL or any(self.sheet.edges[k].cls in VIRTUAL for k in self.sheet.at[n]):
            return
        if how != "free" and p.cls not in r["through"]:
            return
        pop = self.people(*self.sheet.nodes[n])
        enough = p.cls == "arterial" or pop >= r["least_people"][p.cls]
        if not rng.chance(r["stop"][p.cls]) and p.depth < r["deepest"][p.cls] and enough:
            self.propose(p.time + 1, n, heading, p.cls, p.depth + 1, p.road, p.free)
        if how != "free":
            return
        for side in (-1, 1):
            if not rng.chance(r["branch"][p.cls] * (1 if p.cls == "arterial" else 0.6 + 0.4 * pop)):
                continue
            own = rng.chance(r["arterial_branch"] if p.cls == "arterial" else 0.25)
            cls = {"arterial": ("collector", "arterial"), "collector": ("local", "collector"), "local": ("local", "local")}[p.cls][own]
            if cls == "arterial" or pop >= r["least_people"][cls]:
                self.propose(p.time + r["delay"][cls], n, heading + side * math.pi / 2, cls, 0, None)

    def step(self, p: Proposal) -> None:
        r = self.rules
        self.stats["proposals"] += 1
        at = self.sheet.nodes[p.start]
        if self.wet(*at):
            self.stats["rejected"] += 1
            self.stats["rejected_water"] += 1
            return
        heading = p.heading
        if not p.free:
            major = self.field(*at)
            wanted = min((major + k * math.pi / 2 for k in range(4)), key=lambda a: abs(turn(a, heading)))
            heading += max(-r["most_turn"], min(r["most_turn"], turn(wanted, heading)))
        if r["jitter"]:
            heading += self.rng.between(-r["jitter"], r["jitter"])
        enter, leave = self.banks(at, heading, p.length)
        reach = lambda start, d: (self.sheet.nodes[start][0] + math.cos(heading) * d, self.sheet.nodes[start][1] + math.sin(heading) * d)
        if enter is not None and leave is not None and leave - enter <= r["bridge_span"] and self.rng.chance(r["bridge"][p.cls]):
            start = p.start
            if enter > r["shortest"] * 0.6:
                got = self.lay(start, reach(start, enter + 1), p.cls, p.road)
                if isinstance(got, str):
                    self.refuse(got)
                    return
                start = got[0]
            span = leave + 1 - math.dist(at, self.sheet.nodes[start])
            got = self.lay(start, reach(start, span), p.cls, p.road, bridge=True)
            if isinstance(got, str):
                self.refuse(got)
            elif got[1] == "free":
                self.propose(p.time + 1, got[0], heading, p.cls, p.depth + 1, p.road, p.free)
            return
        length = p.length if enter is None else enter + 1
        if length < r["shortest"]:
            self.stats["rejected"] += 1
            return
        got = self.lay(p.start, reach(p.start, length), p.cls, p.road)
        if got == "grade":  # shorter, then turned a little
            for aside in (0.0, -0.25, 0.25, -0.5, 0.5, -1.0, 1.0):
                for part in (1.0, 0.8, 0.6, 0.45):
                    h = p.heading + aside * r["most_turn"]
                    if length * part >= r["shortest"] and got == "grade":
                        got = self.lay(p.start, (at[0] + math.cos(h) * length * part, at[1] + math.sin(h) * length * part), p.cls, p.road)
        if isinstance(got, str):
            self.refuse(got)
        elif enter is None:
            self.branch(p, got[0], heading, got[1])

    def refuse(self, why: str) -> None:
        self.stats["rejected"] += 1
        if why in ("grade", "water"):
            self.stats[f"rejected_{why}"] += 1

    def run(self) -> Sheet:
        tries = 0
        while self.queue and self.built < self.budget and tries < self.budget * 40:
            tries += 1
            self.step(heapq.heappop(self.queue))
        self.keep_largest()
        self.stats |= {"edges": len(self.sheet.live()), "nodes": len(self.sheet.nodes), "queued": len(self.queue)}
        return self.sheet

    def keep_largest(self) -> None:
        """Takes away the roads that the largest part, by edges, does not reach; of equals the first stays."""
        s, seen, parts = self.sheet, set(), []
        live = set(s.live())
        for k in sorted(live):
            if k in seen:
                continue
            part, todo = [], [k]
            seen.add(k)
            while todo:
                e = todo.pop()
                part.append(e)
                for n in (s.edges[e].a, s.edges[e].b):
                    for f in s.at[n]:
                        if f in live and f not in seen:
                            seen.add(f)
                            todo.append(f)
            parts.append(part)
        main = max(parts, key=len, default=[])
        for k in live - set(main):
            e = s.edges[k]
            e.removed = True
            s.at[e.a].remove(k)
            s.at[e.b].remove(k)
        self.stats |= {"components": len(parts), "disconnected": len(live) - len(main)}


def faces(sheet: Sheet, least: float = 1.0) -> tuple[list[tuple[list[int], list[int]]], int]:
    """(nodes, edges) of each inner face, counter-clockwise, and the number of edges that hang on dead ends."""
    alive = {k for k, e in enumerate(sheet.edges) if not e.removed}
    around = {n: [k for k in ks if k in alive] for n, ks in enumerate(sheet.at)}
    loose = [n for n, ks in around.items() if len(ks) == 1]
    spurs = 0
    while loose:
        n = loose.pop()
        if len(around[n]) != 1:
            continue
        k = around[n].pop()
        alive.discard(k)
        spurs += 1
        e = sheet.edges[k]
        m = e.b if e.a == n else e.a
        around[m].remove(k)
        if len(around[m]) == 1:
            loose.append(m)
    order = {n: sorted(ks, key=lambda k, n=n: (sheet.heading(n, k), k)) for n, ks in around.items() if ks}
    place = {(n, k): i for n, ks in order.items() for i, k in enumerate(ks)}
    found, used = [], set()
    for k in sorted(alive):
        for start in (sheet.edges[k].a, sheet.edges[k].b):
            if (k, start) in used:
                continue
            nodes, ids, e, n = [], [], k, start
            while (e, n) not in used:
                used.add((e, n))
                nodes.append(n)
                ids.append(e)
                n = sheet.edges[e].b if sheet.edges[e].a == n else sheet.edges[e].a
                ks = order[n]
                e = ks[place[n, e] - 1]
            if area([sheet.nodes[i] for i in nodes]) > least:
                found.append((nodes, ids))
    return found, spurs


def shortest_path(sheet: Sheet, start: int, goal: int, speeds: dict[str, float]) -> list[int] | None:
    """Edges of the quickest way, by A*; None if there is none. Ties go to the shorter way, then to the smaller node."""
    fastest = max(speeds.values())
    end = sheet.nodes[goal]
    best, came = {start: 0.0}, {}
    heap = [(math.dist(sheet.nodes[start], end) / fastest, 0.0, start)]
    done = set()
    while heap:
        _, g, n = heapq.heappop(heap)
        if n == goal:
            path = []
            while n != start:
                path.append(came[n][1])
                n = came[n][0]
            return path[::-1]
        if n in done:
            continue
        done.add(n)
        for k in sheet.at[n]:
            e = sheet.edges[k]
            if e.removed or e.cls in VIRTUAL:
                continue
            m = e.b if e.a == n else e.a
            cost = g + math.dist(*sheet.ends(k)) / speeds.get(e.cls, speeds["local"])
            if cost < best.get(m, math.inf) - 1e-12:
                best[m], came[m] = cost, (n, k)
                heapq.heappush(heap, (cost + math.dist(sheet.nodes[m], end) / fastest, cost, m))
    return None
