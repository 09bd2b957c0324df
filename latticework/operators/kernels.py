"""Sequential graph and dense kernels in numpy, run inside grouped functions."""

from __future__ import annotations

import heapq

import numpy as np

from .graph import neighbours


def grid_places(i: np.ndarray, nx: int, ny: int, nz: int, leaf: int = 15) -> np.ndarray:
    """Places of vertices i of a regular grid (x fastest): halves first, the one-layer separator last.

    The longest direction is cut, x before y before z on ties; fewer than `leaf` vertices stay as they are.
    All vertices descend at once, each in its own box, from the whole grid to its separator or leaf.
    """
    at = np.stack([i % nx, i // nx % ny, i // (nx * ny)])
    low, high = np.zeros_like(at), np.repeat(np.array([[nx], [ny], [nz]], dtype=np.int64), len(i), axis=1)
    base, out = np.zeros(len(i), dtype=np.int64), np.empty(len(i), dtype=np.int64)

    def inside(v: np.ndarray) -> np.ndarray:
        x, y, z = at[:, v] - low[:, v]
        width, depth, _ = high[:, v] - low[:, v]
        return (z * depth + y) * width + x

    todo = np.arange(len(i))
    while len(todo):
        size = high[:, todo] - low[:, todo]
        small = size.prod(axis=0) < leaf
        done = todo[small]
        out[done] = base[done] + inside(done)
        todo, size = todo[~small], size[:, ~small]
        axis, column = size.argmax(axis=0), np.arange(len(todo))
        cut = low[axis, todo] + size[axis, column] // 2
        layer = size.prod(axis=0) // size[axis, column]
        left, right = layer * (cut - low[axis, todo]), layer * (high[axis, todo] - cut - 1)
        c = at[axis, todo]
        on = c == cut
        v = todo[on]
        low[axis[on], v], high[axis[on], v] = cut[on], cut[on] + 1
        out[v] = base[v] + left[on] + right[on] + inside(v)
        before, after = c < cut, c > cut
        high[axis[before], todo[before]] = cut[before]
        low[axis[after], todo[after]] = cut[after] + 1
        base[todo[after]] += left[after]
        todo = todo[~on]
    return out


def grid_regions(i: np.ndarray, nx: int, ny: int, nz: int, leaf: int) -> np.ndarray:
    """Paths of vertices i of a regular grid: a digit 0 or 1 for each halving of grid_places, down to boxes of fewer than `leaf` vertices, and a last digit 2 on a separator."""
    at = np.stack([i % nx, i // nx % ny, i // (nx * ny)])
    low, high = np.zeros_like(at), np.repeat(np.array([[nx], [ny], [nz]], dtype=np.int64), len(i), axis=1)
    out, todo = np.full(len(i), "", dtype=object), np.arange(len(i))
    while len(todo):
        size = high[:, todo] - low[:, todo]
        large = size.prod(axis=0) >= leaf
        todo, size = todo[large], size[:, large]
        axis = size.argmax(axis=0)
        cut = low[axis, todo] + size[axis, np.arange(len(todo))] // 2
        c = at[axis, todo]
        for digit, of in (("0", c < cut), ("1", c > cut), ("2", c == cut)):
            out[todo[of]] += digit
        high[axis[c < cut], todo[c < cut]] = cut[c < cut]
        low[axis[c > cut], todo[c > cut]] = cut[c > cut] + 1
        todo = todo[c != cut]
    return out


def dissect(starts: np.ndarray, targets: np.ndarray, leaf: int = 24) -> np.ndarray:
    """Nested dissection of a graph by level-set separators: perm of each vertex."""
    n = len(starts) - 1
    perm = np.full(n, -1, dtype=np.int64)
    mark = np.zeros(n, dtype=np.int64)
    stamp = 0
    todo = [(np.arange(n), n)]
    while todo:
        members, end = todo.pop()
        if len(members) <= leaf:
            degree = np.array([starts[v + 1] - starts[v] for v in members])
            perm[members[np.argsort(degree, kind="stable")]] = end - len(members) + np.arange(len(members))
            continue
        root = members[0]
        for _ in range(2):
            stamp += 1
            mark[members] = -stamp
            levels, front = [], np.array([root])
            mark[root] = stamp
            while len(front):
                levels.append(front)
                nearby = np.unique(np.concatenate([targets[starts[v] : starts[v + 1]] for v in front]))
                front = nearby[mark[nearby] == -stamp]
                mark[front] = stamp
            root = levels[-1][0]
        rest = members[mark[members] == -stamp]
        if len(rest):  # several components
            found = np.concatenate(levels)
            todo += [(found, end - len(rest)), (rest, end)]
            continue
        sizes = np.cumsum([len(x) for x in levels])
        if len(levels) < 3:
            perm[members] = end - len(members) + np.arange(len(members))
            continue
        middle = min(max(1, int(np.searchsorted(sizes, len(members) / 2))), len(levels) - 2)
        low, sep, high = np.concatenate(levels[:middle]), levels[middle], np.concatenate(levels[middle + 1 :])
        perm[sep] = end - len(sep) + np.arange(len(sep))
        todo += [(high, end - len(sep)), (low, end - len(sep) - len(high))]
    return perm


def bisect(weight: np.ndarray, starts: np.ndarray, targets: np.ndarray, w: np.ndarray, most: float) -> np.ndarray:
    """Side 0 or 1 of each vertex: half the weight grown from the best of a few roots, then moves by gain while they help.

    A side holds at most the part `most` of the weight, as far as single vertices allow.
    """
    n, total = len(weight), int(weight.sum())
    source = np.repeat(np.arange(n), np.diff(starts))

    def grown(root: int) -> np.ndarray:
        """Vertices in the order in which a front that always takes the one tied closest to it meets them."""
        seen, tie = np.zeros(n, dtype=bool), np.zeros(n)
        order, heap, rest = [], [(0.0, root)], 0
        while len(order) < n:
            while heap:
                key, v = heapq.heappop(heap)
                if not seen[v] and -key == tie[v]:
                    break
            else:
                while seen[rest]:
                    rest += 1
                v = rest
            seen[v] = True
            order.append(v)
            for at in range(starts[v], starts[v + 1]):
                u = targets[at]
                if not seen[u]:
                    tie[u] += w[at]
                    heapq.heappush(heap, (-tie[u], u))
        return np.array(order)

    def cut_of(side: np.ndarray) -> int:
        return int(w[side[source] != side[targets]].sum())

    def split(order: np.ndarray) -> np.ndarray:
        side = np.ones(n, dtype=np.int32)
        side[order[: max(1, int(np.searchsorted(np.cumsum(weight[order]), total / 2)))]] = 0
        return side

    first = grown(0)
    tries = [split(first), split(grown(int(first[-1]))), split(grown(int(first[n // 2])))]
    side = min(tries, key=cut_of)
    for _ in range(4):  # passes of moves by gain; a pass is taken back to its best moment
        differs = side[source] != side[targets]
        gain = np.bincount(source, np.where(differs, w, -w), n)
        heap = [(-gain[v], v) for v in np.unique(source[differs]).tolist()]
        heapq.heapify(heap)
        held = np.array([weight[side == 0].sum(), weight[side == 1].sum()])
        moved, fixed, now, best, upto = [], np.zeros(n, dtype=bool), 0.0, 0.0, 0
        while heap and len(moved) - upto < 200:
            key, v = heapq.heappop(heap)
            if fixed[v] or -key != gain[v] or held[1 - side[v]] + weight[v] > most * total:
                continue
            fixed[v] = True
            now += gain[v]
            held[side[v]] -= weight[v]
            side[v] = 1 - side[v]
            held[side[v]] += weight[v]
            moved.append(v)
            for at in range(starts[v], starts[v + 1]):
                u = targets[at]
                gain[u] += 2 * w[at] if side[u] != side[v] else -2 * w[at]
                if not fixed[u]:
                    heapq.heappush(heap, (-gain[u], int(u)))
            if now > best:
                best, upto = now, len(moved)
        for v in moved[upto:]:
            side[v] = 1 - side[v]
        if best <= 0:
            break
    return side


def dissected_postorder(starts: np.ndarray, targets: np.ndarray, leaf: int = 24) -> np.ndarray:
    """Nested dissection followed by a postorder of its elimination tree: columns of a supernode stand together, fill stays."""
    perm = dissect(starts, targets, leaf)
    source = np.repeat(np.arange(len(perm)), np.diff(starts))
    a, b = perm[source], perm[targets]
    return postorder(elimination_tree(*neighbours(a, b, len(perm))))[perm]


def elimination_tree(starts: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Parent of each vertex of a graph in elimination order; roots are their own parents."""
    n = len(starts) - 1
    parent, top = np.arange(n), np.arange(n)
    for v in range(n):
        for u in targets[starts[v] : starts[v + 1]]:
            if u >= v:
                continue
            while top[u] != v and top[u] != u:
                above = top[u]
                top[u] = v
                u = above
            if top[u] == u and u != v:
                top[u] = parent[u] = v
    return parent


def structures(starts: np.ndarray, targets: np.ndarray, parent: np.ndarray) -> list[np.ndarray]:
    """Per column the rows below its diagonal in the factor: own ones and those of its children."""
    n = len(parent)
    below: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * n
    gathered: list[list[np.ndarray]] = [[] for _ in range(n)]
    for j in range(n):
        own = targets[starts[j] : starts[j + 1]]
        rows = np.unique(np.concatenate([own[own > j], *gathered[j]]))
        rows = rows[rows > j]
        below[j] = rows
        gathered[j] = []
        if parent[j] != j:
            gathered[parent[j]].append(rows)
    return below


def postorder(parent: np.ndarray) -> np.ndarray:
    """Place of each vertex in a postorder; siblings keep their order. Parents have larger numbers than children."""
    n = len(parent)
    size = np.ones(n, dtype=np.int64)
    for v in range(n):
        if parent[v] != v:
            size[parent[v]] += size[v]
    begin, used, roots = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
    # fathers first: each hands out places to its children in ascending order
    kids: list[list[int]] = [[] for _ in range(n)]
    for v in range(n):
        if parent[v] != v:
            kids[parent[v]].append(v)
    for v in range(n - 1, -1, -1):
        at = begin[v]
        for c in kids[v]:
            begin[c] = at
            at += size[c]
    for v in range(n):
        if parent[v] == v:
            used[v], roots = roots, roots + size[v]
    top = np.arange(n)
    for v in range(n - 1, -1, -1):
        top[v] = v if parent[v] == v else top[parent[v]]
    return begin + used[top] + size - 1


def amalgamate(first: list[int], width: list[int], rows: list[np.ndarray], parent: list[int], ratio: float) -> list[int]:
    """Merges supernodes into their fathers where that adds few zeros: the representative (the last) of each.

    Merges that add nothing come first; then those with the least new zeros, until these exceed
    ratio * (entries of the factor). A son merges only if its columns end where its father's begin.
    """
    import heapq

    k = len(first)
    into = list(range(k))
    nnz = sum(w * (w + 1) // 2 + w * len(r) for w, r in zip(width, rows, strict=True))
    first, width = list(first), list(width)
    alive = [True] * k

    def fill(s: int) -> int:
        f = parent[s]
        w, v = width[s], width[f]
        return w * (v + len(rows[f]) - len(rows[s]))

    def find(s: int) -> int:
        while into[s] != s:
            into[s] = into[into[s]]
            s = into[s]
        return s

    ends = {first[s] + width[s]: s for s in range(k)}  # columns follow each other, so one supernode ends at a place
    heap = [(fill(s), s) for s in range(k) if parent[s] != s and first[s] + width[s] == first[parent[s]]]
    heapq.heapify(heap)
    budget, used = ratio * nnz, 0
    while heap:
        cost, s = heapq.heappop(heap)
        f = find(parent[s])
        if not alive[s] or f == s or first[s] + width[s] != first[f]:
            continue
        parent[s] = f
        now = fill(s)
        if now != cost:
            heapq.heappush(heap, (now, s))
            continue
        if used + cost > budget and cost > 0:
            continue
        used += cost
        alive[s] = False
        into[s] = f
        first[f] = first[s]
        width[f] += width[s]
        # the merged supernode begins where its son began: who ends there may be a son in turn
        c = ends.get(first[f])
        if c is not None and alive[c] and c != f and find(parent[c]) == f:
            heapq.heappush(heap, (fill(c) if parent[c] == f else 0, c))
    return [find(s) for s in range(k)]


def hamming_order(sets: list[frozenset], stop: int) -> list[int]:
    """Rows in an order that keeps similar sets together: insertion into a tour at the cheapest place.

    The tour begins at a ghost row with an empty set and is cut there. Distances beyond stop count as stop.
    """
    if len(sets) < 3:
        return list(range(len(sets)))

    def d(a: frozenset, b: frozenset) -> int:
        return min(stop, len(a ^ b))

    empty: frozenset = frozenset()
    tour = [-1, 0]
    at = lambda v: empty if v < 0 else sets[v]
    for v in range(1, len(sets)):
        best = None
        for p in range(len(tour)):
            a, b = at(tour[p]), at(tour[(p + 1) % len(tour)])
            x, y = d(a, sets[v]), d(sets[v], b)
            key = (x + y - d(a, b), min(x, y))
            if best is None or key < best[0]:
                best = (key, p)
            if x == 0 and tour[p] >= 0:
                best = (key, p)
                break
        tour.insert(best[1] + 1, v)
    return tour[1:]


#: Columns that are eliminated one by one before the rest of the front is updated by one matrix product.
PANEL = 48


def factor_front(front: np.ndarray, pivots: int, kind: str, criterion: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Eliminates the first columns of a dense front, a panel at a time.

    Returns L (columns, unit diagonal except for LLT and LLH), D or the rows of U, the remaining
    Schur block and the number of pivots replaced. A pivot smaller than criterion is replaced: by
    plus the criterion in Cholesky, else by plus or minus it, after the sign of its real part.
    """
    a = front.copy()
    m, fixed = len(a), 0
    hermitian, cholesky, general = kind in ("LLH", "LDLH"), kind in ("LLT", "LLH"), kind == "LU"
    mirror = np.conj if hermitian else np.asarray
    for begin in range(0, pivots, PANEL):
        end = min(begin + PANEL, pivots)
        for c in range(begin, end):
            p = a[c, c]
            if abs(p) < criterion:
                fixed += 1
                p = criterion if cholesky or p.real >= 0 else -criterion
            if cholesky:
                p = np.sqrt(p) if np.iscomplexobj(a) or p.real >= 0 else np.nan
            a[c, c] = p
            a[c + 1 :, c] /= p
            if c + 1 < end:
                # the panel's own columns; of LU its rows beyond the panel follow below
                row = a[c, c + 1 : end] if general else mirror(a[c + 1 : end, c]) * (1 if cholesky else p)
                a[c + 1 :, c + 1 : end] -= np.outer(a[c + 1 :, c], row)
        low = a[end:, begin:end]
        if general:
            # rows of U: the panel's unit lower triangle is solved with
            for c in range(begin, end - 1):
                a[c + 1 : end, end:] -= np.outer(a[c + 1 : end, c], a[c, end:])
            a[end:, end:] -= low @ a[begin:end, end:]
        else:
            right = low if cholesky else low * np.diag(a)[begin:end]
            a[end:, end:] -= right @ mirror(low).T
    low = np.tril(a[:, :pivots])
    if cholesky:
        up = np.zeros((0, m), a.dtype)
    elif general:
        up = np.triu(a[:pivots])
    else:
        up = np.diag(a)[:pivots].copy()
    if not cholesky:
        low[np.arange(pivots), np.arange(pivots)] = 1
    return low, up, a[pivots:, pivots:], fixed


def united_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans first to last of integers, in order; spans that touch are one."""
    if len(first) < 2:
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    opens = np.flatnonzero(first[1:] > reach[:-1] + 1) + 1
    return first[np.concatenate(([0], opens))], reach[np.concatenate((opens - 1, [len(first) - 1]))]


def column_spans(columns: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple]:
    """Symbolic elimination of some columns from their entries (column, rows begin to end): (first, last, height, spans, None) for each run of columns.

    A run is a chain of consecutive columns, each the only child of the next and with its rows; height and spans (first, last, first, ...) are
    the rows below its last column. A structure takes memory by its spans, not by its rows. Rows that a column has for a father
    outside are given too: (father, father, rows, spans, father).
    """
    order = np.lexsort((begin, columns))
    columns, begin, end = columns[order], begin[order], end[order]
    names, starts = np.unique(columns, return_index=True)
    ends = np.append(starts[1:], len(columns))
    inside = set(names.tolist())
    kids: dict[int, list[tuple]] = {}
    out, first, last, held = [], None, None, None

    def run(first: int, last: int, height: int, a: np.ndarray, b: np.ndarray, to: int | None) -> None:
        out.append((first, last, height, np.column_stack((a, b)).ravel(), to))

    for name, x, y in zip(names.tolist(), starts, ends, strict=True):
        a, b = begin[x:y], end[x:y]
        on = b > name
        a, b = np.maximum(a[on], name + 1), b[on]
        given = kids.pop(name, [])
        if given:
            a, b = np.concatenate([a, *(g[1] for g in given)]), np.concatenate([b, *(g[2] for g in given)])
        a, b = united_spans(a, b)
        height = int((b - a).sum()) + len(a)
        if held is not None and last == name - 1 and len(given) == 1 and given[0][0] == last and height == held[0] - 1:
            last = name
        else:
            if held is not None:
                run(first, last, *held, None)
            first = last = name
        held = height, a, b
        if height:
            father = int(a[0])
            cut = 1 if a[0] == b[0] else 0
            further = a[cut:].copy(), b[cut:]
            if not cut:
                further[0][0] += 1
            if father in inside:
                kids.setdefault(father, []).append((name, *further))
            elif height > 1:
                run(father, father, height - 1, *further, father)
    if held is not None:
        run(first, last, *held, None)
    return out


def column_runs(columns: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """As column_spans from entries (column, row), each row below a run listed: (first, last, rows, None), and what is given (father, father, further rows, father)."""
    every = lambda s: np.concatenate([np.arange(a, b + 1) for a, b in s.reshape(-1, 2)]) if len(s) else s
    return [(first, last, every(spans), to) for first, last, _, spans, to in column_spans(columns, rows, rows)]


def merge_rounds(first: list[int], last: list[int], height: list[int], head: list[int], most: int) -> list[tuple[int, int, int]]:
    """Merges (at, round, zeros) of consecutive supernodes in rounds, at the last column of a son. head is the first row below a supernode, -1 for none.

    All merges of a round that add fewer zeros than the ones next to them (ties: the first column) are taken; those of more than `most` zeros never.
    Only what a merge touched is looked at again, so the work grows with the merges, whatever the number of rounds.
    """
    n = len(first)
    first, before, after = list(first), list(range(-1, n - 1)), list(range(1, n + 1))
    # a supernode goes by the number of its last one; zeros of merging it into the next one
    zeros: list[int | None] = [None] * (n + 1)

    def cost(a: int) -> int | None:
        b = after[a]
        if b >= n or not 0 <= head[a] <= last[b]:
            return None
        z = (last[a] - first[a] + 1) * (last[b] - first[b] + 1 + height[b] - height[a])
        return z if z <= most else None

    for a in range(n):
        zeros[a] = cost(a)

    def least(a: int) -> bool:
        z = zeros[a]
        if z is None:
            return False
        lower = zeros[before[a]] if before[a] >= 0 else None
        upper = zeros[after[a]] if after[a] < n else None
        return (lower is None or z < lower) and (upper is None or z <= upper)

    out, number, look = [], 0, range(n)
    while True:
        taken = [a for a in look if least(a)]
        if not taken:
            return out
        number += 1
        near: set[int] = set()
        for a in taken:
            out.append((last[a], number, zeros[a]))
        for a in taken:
            b, p = after[a], before[a]
            first[b], before[b], zeros[a] = first[a], p, None
            if p >= 0:
                after[p] = b
        for a in taken:
            b = after[a]
            near.add(b)
            if before[b] >= 0:
                near.add(before[b])
        for a in near:
            zeros[a] = cost(a)
        look = near | {before[a] for a in near if before[a] >= 0} | {after[a] for a in near if after[a] < n}


def merged(first: list[int], last: list[int], height: list[int], head: list[int], left: int) -> tuple[list[int], list[int], list[int]]:
    """first, last and height of supernodes after merging by merge_rounds while all zeros together are at most `left`: the last round's merges are taken from the cheapest on, and what the rest can pay is tried again."""
    while True:
        merges = merge_rounds(first, last, height, head, left)
        rounds: dict[int, list] = {}
        for at, number, zeros in merges:
            rounds.setdefault(number, []).append((zeros, at))
        gone: set[int] = set()
        ended = False
        for number in sorted(rounds):
            ended = sum(z for z, _ in rounds[number]) > left
            for zeros, at in sorted(rounds[number]):
                if zeros > left:
                    break
                left -= zeros
                gone.add(at)
            if ended:
                break
        keep, begin = [], None
        for n, z in enumerate(last):
            begin = first[n] if begin is None else begin
            if z not in gone:
                keep.append((begin, z, height[n], head[n]))
                begin = None
        first, last, height, head = ([x[c] for x in keep] for c in range(4))
        if not gone or not ended:
            return first, last, height


def cut_tree(parent: list[int], width: list[int], entries: list[int], limit: int, room: int) -> tuple[list[int], list[int]]:
    """The group of each node, named by its top node, and its stage; nodes in an order with sons before fathers, a root its own father.

    Stage 0 are the subtrees of at most `limit` columns. Of what is left, subtrees that have no more columns and no more than `room` entries of
    fronts are the groups of the next stage, as is a node without sons there; and so on.
    """
    n = len(parent)
    top, stage = list(range(n)), [0] * n
    left, now = list(range(n)), 0
    while left:
        w, e, sons = {k: width[k] for k in left}, {k: entries[k] for k in left}, set()
        for k in left:
            p = parent[k]
            if p != k:
                w[p] += w[k]
                e[p] += e[k]
                sons.add(p)
        taken = {k for k in left if w[k] <= limit and (not now or e[k] <= room) or (now and k not in sons)}
        for k in reversed(left):
            if k in taken:
                p = parent[k]
                top[k], stage[k] = (top[p] if p != k and p in taken else k), now
        left = [k for k in left if k not in taken]
        now += 1
    return top, stage
