"""Bin completion branch-and-bound over a histogram of sizes.

Sizes are whole numbers of at most ``cap``, so any number of items is a histogram of ``cap`` counts: the search
sees at most ``cap`` numbers, whatever the number of documents. A bin type is a filling with a number of copies.

The search takes the largest size left, enumerates the undominated fillings around it (sizes that fit beside
it, of which none replaces another's items by larger ones within the same room), best fit first, uses each as many
times as the counts allow, and goes on with the rest. A branch ends when the waste it has made leaves it no way
to beat the incumbent, or its lower bound does. Each node's rest is also packed best fit decreasing; the best of those is
the incumbent. ``NODES`` bounds the search's effort; when it ends early, the incumbent is used, which packs all items.
"""

from __future__ import annotations

from bisect import bisect_left, insort

#: Nodes of the search, fillings tried at a node, and fillings looked at before the best are chosen.
NODES, BRANCHES, LOOKED_AT = 500, 12, 400

Filling = tuple[tuple[int, int], ...]  # (size, times), largest size first
Plan = list[tuple[Filling, int]]  # fillings with copies


def lower_bound(counts: dict[int, int], cap: int) -> int:
    """The larger of the total over the capacity and Martello and Toth's bound."""
    sizes = sorted(counts, reverse=True)
    total = sum(s * n for s, n in counts.items())
    best = -(-total // cap)
    half = [s for s in sizes if s * 2 <= cap]
    big = [(s, counts[s]) for s in sizes if s * 2 > cap]
    n_big = sum(n for _, n in big)
    best = max(best, n_big)
    small_sum = 0
    for k in half:  # the small sizes from the largest down: those of at least k count
        small_sum += k * counts[k]
        fits = [(s, n) for s, n in big if s <= cap - k]
        room = sum((cap - s) * n for s, n in fits)
        best = max(best, n_big + max(0, -(-(small_sum - room) // cap)))
    return best


def best_fit_decreasing(counts: dict[int, int], cap: int) -> Plan:
    """Best fit decreasing, a whole class of equal bins at a time."""
    room: dict[int, list[list]] = {}  # free room: classes of [filling, copies]
    keys: list[int] = []

    def put(free: int, filling: Filling, n: int) -> None:
        if n:
            if free not in room:
                room[free] = []
                insort(keys, free)
            room[free].append([filling, n])

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(keys, s)
            if at == len(keys):
                each = cap // s
                full, rest = divmod(left, each)
                put(cap - each * s, ((s, each),), full)
                if rest:
                    put(cap - rest * s, ((s, rest),), 1)
                break
            free = keys[at]
            filling, n = room[free].pop()
            if not room[free]:
                del room[free]
                keys.pop(at)
            each = free // s
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            put(free - each * s, (*filling, (s, each)), full)
            n -= full
            left -= full * each
            if n and left:  # one bin more takes what is left of this size
                rest = min(left, each)
                put(free - rest * s, (*filling, (s, rest)), 1)
                n -= 1
                left -= rest
            put(free, filling, n)
    return [(f, n) for classes in room.values() for f, n in classes]


def _fits_into(items: list[int], slots: list[int]) -> bool:
    """Can the items be put into slots of these sizes?"""
    if not items:
        return True
    head, tried = items[0], set()
    for i, room in enumerate(slots):
        if room >= head and room not in tried:
            tried.add(room)
            if _fits_into(items[1:], sorted([*slots[:i], room - head, *slots[i + 1 :]], reverse=True)):
                return True
    return False


def fillings(counts: dict[int, int], first: int, cap: int, waste: int) -> list[Filling]:
    """Undominated fillings around one item of size ``first`` that waste at most ``waste``, best fit first."""
    sizes = sorted((s for s in counts if s <= cap - first), reverse=True)
    below = [0] * (len(sizes) + 1)  # room that the sizes from here on can fill
    for i in range(len(sizes) - 1, -1, -1):
        below[i] = below[i + 1] + sizes[i] * (counts[sizes[i]] - (sizes[i] == first))
    found: list[tuple[int, list[int]]] = []
    looked = 0

    def walk(i: int, free: int, taken: list[int]) -> None:
        nonlocal looked
        looked += 1
        if looked > LOOKED_AT * 20 or len(found) >= LOOKED_AT:
            return
        while i < len(sizes) and sizes[i] > free:
            i += 1
        if i == len(sizes):
            if free <= waste:
                found.append((free, taken))
            return
        if free - below[i] > waste:
            return
        s = sizes[i]
        for times in range(min(free // s, counts[s] - (s == first)), -1, -1):
            walk(i + 1, free - times * s, taken + [s] * times)
            if found and found[-1][0] == 0 and len(found[-1][1]) <= 1:
                return  # one item that fills the room exactly dominates all else

    walk(0, cap - first, [])
    found.sort(key=lambda f: (f[0], len(f[1])))
    kept: list[list[int]] = []
    for _, taken in found:
        if len(kept) >= BRANCHES:
            break
        if not any(len(k) <= 8 and len(taken) <= 8 and _fits_into(taken, k) for k in kept):
            kept.append(taken)
    out = []
    for taken in kept:
        all_sizes = [first, *taken]
        out.append(tuple((s, all_sizes.count(s)) for s in sorted(set(all_sizes), reverse=True)))
    return out


def pack(counts: dict[int, int], cap: int, nodes: int = NODES) -> Plan:
    """Fillings with copies that use up every count."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > cap:
        raise ValueError("sizes must lie between 1 and the capacity")
    used_bins = lambda plan: sum(n for _, n in plan)
    bound = lower_bound(counts, cap)
    best = best_fit_decreasing(counts, cap)
    budget = nodes
    total = sum(s * n for s, n in counts.items())
    stack: list[tuple[dict[int, int], tuple | None, int]] = [(counts, None, 0)]  # counts left, linked bins, bins used
    while stack and budget and used_bins(best) > bound:
        left, done, bins = stack.pop()
        budget -= 1
        if bins + lower_bound(left, cap) >= used_bins(best):
            continue
        if done:
            rest = best_fit_decreasing(left, cap)
            if bins + used_bins(rest) < used_bins(best):
                linked, made = done, []
                while linked:
                    made.append(linked[0])
                    linked = linked[1]
                best = made + rest
        # waste that still beats the incumbent
        spare = (used_bins(best) - 1) * cap - total
        wasted = bins * cap - (total - sum(s * n for s, n in left.items()))
        first = max(left)
        branches = []
        for filling in fillings(left, first, cap, spare - wasted):
            copies = min(left[s] // times for s, times in filling)
            after = dict(left)
            for s, times in filling:
                after[s] -= copies * times
                if not after[s]:
                    del after[s]
            if after:
                branches.append((after, ((filling, copies), done), bins + copies))
            elif bins + copies < used_bins(best):
                linked, made = ((filling, copies), done), []
                while linked:
                    made.append(linked[0])
                    linked = linked[1]
                best = made
        stack.extend(reversed(branches))  # best fit is tried first
    return best
