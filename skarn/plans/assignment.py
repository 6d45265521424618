"""Parts of the globe for the assignment of crews, and the work of one task: zones in order, each with its nearest free crew."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skarn.functions.geo import EARTH_RADIUS_KM

#: Cubes that positions are counted by: 64 along an axis of the unit sphere, some 200 km wide, 20,000 around the globe.
LEVEL = 6
SIDE = 2.0 / (1 << LEVEL)
#: The holder of a free crew, behind every zone.
FREE = (1 << 63) - 1
#: Positions in a leaf of the tree.
LEAF = 32
#: Chords this much apart may be one distance; a chord this much below the reach is safely inside.
TIE, INSIDE = 1e-11, 1e-9


def split_cubes(zones: dict[tuple, int], crews: dict[tuple, int], most_zones: int, most_crews: int, level: int = 0) -> list[list[tuple]]:
    """The cubes of ``zones`` in parts that have any: an octree whose cubes are cut while they hold more zones or crews than that."""
    if not any(zones.values()):
        return []
    if level == LEVEL or (sum(zones.values()) <= most_zones and sum(crews.values()) <= most_crews):
        return [sorted(zones)]
    down = LEVEL - level - 1
    eighth: dict[tuple, tuple[dict, dict]] = {}
    for i, held in enumerate((zones, crews)):
        for cube, n in held.items():
            eighth.setdefault(tuple(a >> down for a in cube), ({}, {}))[i][cube] = n
    return [part for k in sorted(eighth) for part in split_cubes(*eighth[k], most_zones, most_crews, level + 1)]


def cubes_in_reach(part: list[tuple], crews: dict[tuple, int], most: int) -> tuple[list[tuple], float]:
    """The cubes nearest to the part's box that hold ``most`` crews, and the chord from any place of the box within which no crew lies outside them."""
    cubes = np.array(list(crews), dtype=np.int64).reshape(-1, 3)
    box = np.array(part, dtype=np.int64)
    gaps = np.maximum(0, np.maximum(box.min(axis=0) - cubes - 1, cubes - box.max(axis=0) - 1))
    far = (gaps * gaps).sum(axis=1)
    turn = np.argsort(far, kind="stable")
    enough = np.searchsorted(np.cumsum(np.array(list(crews.values()), dtype=np.int64)[turn]), most)
    if enough >= len(turn) or not (beyond := far > far[turn[enough]]).any():
        return list(crews), math.inf
    return [tuple(c) for c in cubes[~beyond].tolist()], math.sqrt(int(far[beyond].min())) * SIDE


def on_sphere(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    y, x = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)


def place_of(lat: float, lng: float) -> tuple[float, float, float]:
    y, x = math.radians(lat), math.radians(lng)
    return math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)


def near_km(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """``geo.haversine_km`` of one pair, rounded to a micrometre."""
    half_lat, half_lng = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half_lng * half_lng
    return round(EARTH_RADIUS_KM * 2 * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1.0 - a))) * 1e9) / 1e9


class FreeCrews:
    """Crews of one task in a tree of boxes over their positions, from which they are only ever taken.

    Crews of one position are a queue by id.  A crew listed at several positions is at each of them
    until it is taken.  A crew costs some tens of bytes beside its id.
    """

    def __init__(self, ids: pa.ChunkedArray, lat: np.ndarray, lng: np.ndarray):
        names = pc.unique(ids)
        self.names = names.take(pc.sort_indices(names))
        rank = pc.index_in(ids, value_set=self.names).to_numpy().astype(np.int64)
        self.rank = rank  # of each given row
        turn = np.lexsort((rank, lng, lat))
        lat, lng, rank = lat[turn], lng[turn], rank[turn]
        moved = (lat[1:] != lat[:-1]) | (lng[1:] != lng[:-1])
        first = np.ones(len(rank), dtype=bool)
        first[1:] = moved | (rank[1:] != rank[:-1])
        place = np.zeros(len(rank), dtype=np.int64)
        place[1:] = np.cumsum(moved)
        lat, lng, rank, place = lat[first], lng[first], rank[first], place[first]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else place
        lat, lng = lat[starts], lng[starts]
        self.queue = rank.tolist()
        sizes = np.diff(np.r_[starts, len(rank)])
        # Places are numbered along the leaves of the tree.
        at = on_sphere(lat, lng)
        along = self._build(at)
        number = np.empty(len(along), dtype=np.int64)
        number[along] = np.arange(len(along))
        self.at = np.ascontiguousarray(at[along].T)
        self.lat, self.lng = lat[along].tolist(), lng[along].tolist()
        self.head, self.left = starts[along].tolist(), sizes[along].tolist()
        by_crew = np.argsort(rank, kind="stable")
        self.places = number[place[by_crew]].tolist()
        self.places_from = np.searchsorted(rank[by_crew], np.arange(len(self.names) + 1)).tolist()
        self.taken = bytearray(len(self.names))

    def _build(self, at: np.ndarray) -> np.ndarray:
        along = np.arange(len(at))
        self.box, self.down, self.up, self.live, self.span = [], [], [], [], []
        self.leaf = [0] * len(at)
        todo = [(0, len(at), -1)] if len(at) else []
        while todo:
            start, end, up = todo.pop()
            node, spots = len(self.box), at[along[start:end]]
            low, high = spots.min(axis=0), spots.max(axis=0)
            self.box.append((*low.tolist(), *high.tolist()))
            self.down.append([])
            self.up.append(up)
            self.live.append(end - start)
            self.span.append((start, end))
            if up >= 0:
                self.down[up].append(node)
            if end - start <= LEAF:
                self.leaf[start:end] = [node] * (end - start)
                continue
            half = (end - start) // 2
            along[start:end] = along[start:end][np.argpartition(spots[:, np.argmax(high - low)], half)]
            todo += [(start, start + half, node), (start + half, end, node)]
        return along

    def any(self) -> bool:
        return bool(self.live) and self.live[0] > 0

    def take(self, crew: int) -> None:
        if self.taken[crew]:
            return
        self.taken[crew] = 1
        for place in self.places[self.places_from[crew] : self.places_from[crew + 1]]:
            self.left[place] -= 1
            if not self.left[place]:
                self.at[0, place] = math.inf
                node = self.leaf[place]
                while node >= 0:
                    self.live[node] -= 1
                    node = self.up[node]

    def first_of(self, place: int) -> int:
        """The free crew of lowest id at a place that has one."""
        h = self.head[place]
        while self.taken[self.queue[h]]:
            h += 1
        self.head[place] = h
        return self.queue[h]

    def _away(self, node: int, x: float, y: float, z: float) -> float:
        a, b, c, d, e, f = self.box[node]
        x = a - x if x < a else x - d if x > d else 0.0
        y = b - y if y < b else y - e if y > e else 0.0
        z = c - z if z < c else z - f if z > f else 0.0
        return x * x + y * y + z * z

    def nearest(self, lat: float, lng: float, x: float, y: float, z: float) -> tuple[float, list[int]]:
        """The places with a free crew at the smallest distance, equal to a micrometre, and a chord that none of them exceeds."""
        best, limit, met = math.inf, math.inf, []
        todo = [(0.0, 0)] if self.any() else []
        while todo:
            away, node = todo.pop()
            if away > limit:
                continue
            if self.down[node]:
                nodes = sorted(((self._away(n, x, y, z), n) for n in self.down[node] if self.live[n]), reverse=True)
                todo += [n for n in nodes if n[0] <= limit]
                continue
            start, end = self.span[node]
            px, py, pz = self.at[:, start:end]
            px, py, pz = px - x, py - y, pz - z
            squared = px * px + py * py + pz * pz
            least = float(squared.min())
            if least <= limit:
                met.append((start, squared))
                if least < best:
                    best = least
                    limit = (math.sqrt(best) + TIE) ** 2
        spots = [start + i for start, squared in met for i in np.flatnonzero(squared <= limit).tolist()]
        if len(spots) > 1:
            near = [near_km(lat, lng, self.lat[s], self.lng[s]) for s in spots]
            least = min(near)
            spots = [s for s, km in zip(spots, near) if km == least]
        return math.sqrt(limit), spots


def serve(zones: pa.Table, crews: pa.Table) -> pa.Table:
    """``key, crew_id, sure``: zones of one part by rising ``key``, each with its nearest crew that is free or held by a zone behind it.

    ``crews`` are those within the chord ``reach`` of any zone of the part, with the key ``holder`` of the zone that holds one and,
    where that zone is of this part, its position ``hlat, hlng``: it is served again, after those before it, if its crew goes.  A zone whose
    nearest crew may lie beyond the reach takes none and is not ``sure``; one that has no crew left anywhere is sure to get none.
    """
    numbers = lambda table, c: table[c].to_numpy()
    zones = zones.sort_by("key")
    holder = pc.fill_null(crews["holder"], FREE).to_numpy()
    if len(zones):  # crews held by zones before all of these are lost to them
        crews = crews.filter(pa.array(holder > zones["key"][0].as_py()))
        holder = pc.fill_null(crews["holder"], FREE).to_numpy()
    free = FreeCrews(crews["id"], numbers(crews, "lat").astype(float), numbers(crews, "lng").astype(float))
    held = np.flatnonzero(holder < FREE)
    turn = held[np.argsort(holder[held], kind="stable")]
    lost = list(zip(holder[turn].tolist(), free.rank[turn].tolist()))[::-1]
    back = dict(zip(free.rank[held].tolist(), zip(*(numbers(crews.take(held), c).tolist() for c in ("holder", "hlat", "hlng")))))
    todo = list(zip(*(numbers(zones, c).tolist() for c in ("key", "lat", "lng"))))  # sorted, so a heap
    reach = zones["reach"][0].as_py() if todo else math.inf
    known: dict[tuple, tuple[float, list[int]]] = {}
    keys: list[int] = []
    got: list[int | None] = []
    sure: list[bool] = []
    while todo:
        key, lat, lng = heapq.heappop(todo)
        while lost and lost[-1][0] < key:
            free.take(lost.pop()[1])
        # The zones come by rising keys, so crews only ever go: what was nearest to a place stays so while a crew is left there.
        chord, places = known.get((lat, lng), (0.0, ()))
        places = [p for p in places if free.left[p]]
        if not places:
            chord, places = known[lat, lng] = free.nearest(lat, lng, *place_of(lat, lng))
        crew = min(map(free.first_of, places)) if chord < reach - INSIDE else None
        keys.append(key)
        got.append(crew)
        sure.append(crew is not None or math.isinf(reach))
        if crew is not None:
            free.take(crew)
            if crew in back and back[crew][1] is not None and not math.isnan(back[crew][1]):
                heapq.heappush(todo, back[crew])
    return pa.table({"key": pa.array(keys, pa.int64()), "crew_id": free.names.take(pa.array(got, pa.int64())), "sure": pa.array(sure, pa.bool_())})
