"""Plain versions of the folds and of linking, on lists of crops, for differential tests. A crop is (vector, upper, lower, frame)."""

import numpy as np


def proto(crops):
    mean = np.mean([c[0] for c in crops], axis=0)
    return mean / np.linalg.norm(mean)


def hists(crops):
    up, lo = (np.sum([c[k] for c in crops], axis=0) for k in (1, 2))
    return up / up.sum(), lo / lo.sum()


def likeness(a, b):
    (u1, l1), (u2, l2) = hists(a), hists(b)
    return float(proto(a) @ proto(b)), float(0.4 * np.minimum(u1, u2).sum() + 0.6 * np.minimum(l1, l2).sum())


def shared(a, b):
    return len({c[3] for c in a} & {c[3] for c in b})


def choose(x, others, reid, color, weight, most=None):
    scores = []
    for i, o in enumerate(others):
        r, c = likeness(x, o)
        if r >= reid and c >= color and (most is None or shared(x, o) <= most):
            scores.append((-(r + weight * c), i))
    return min(scores)[1] if scores else None


def into(groups, x, at):
    return [*groups, x] if at is None else [g + x if i == at else g for i, g in enumerate(groups)]


def leader(crops, t):
    if len(crops) < t.split_min:
        return [list(crops)] if crops else []
    groups = []
    for c in crops:
        groups = into(groups, [c], choose([c], groups, t.split_reid, t.split_color, t.split_weight))
    big, tiny = [g for g in groups if len(g) >= t.reattach_min], [g for g in groups if len(g) < t.reattach_min]
    if not big:
        return groups
    for g in tiny:
        big = into(big, g, choose(g, big, t.reattach_reid, t.reattach_color, t.split_weight))
    return big


def seeds(tracks, t):
    left, out = sorted((x for x in tracks if len(x) >= t.min_track), key=len, reverse=True), []
    while left:
        seed, left = left[0], left[1:]
        again = True
        while again:
            again = False
            for x in list(left):
                r, c = likeness(seed, x)
                if r >= t.split_reid and c >= t.split_color:
                    seed, again = seed + x, True
                    left = [y for y in left if y is not x]
        out.append(seed)
    return out


def agglomerate(clusters, t):
    clusters = list(clusters)
    while True:
        pairs = []
        for i, a in enumerate(clusters):
            for j in range(i + 1, len(clusters)):
                r, c = likeness(a, clusters[j])
                if shared(a, clusters[j]) <= t.max_overlap and r >= t.merge_reid and c >= t.merge_color:
                    pairs.append((-(r + t.merge_weight * c), i, j))
        if not pairs:
            return clusters
        _, i, j = min(pairs)
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [clusters[i] + clusters[j]]


def sequential(clusters, t):
    final = []
    for x in sorted(clusters, key=len, reverse=True):
        scores = []
        if np.linalg.norm(np.mean([c[0] for c in x], axis=0)) >= t.coherence_min:
            for i, o in enumerate(final):
                r, c = likeness(x, o)
                big = max(len(x), len(o)) >= t.large_size
                if shared(x, o) <= t.max_overlap and r >= (t.large_reid if big else t.merge_reid) and c >= (t.large_color if big else t.merge_color):
                    scores.append((-(r + t.merge_weight * c), i))
        final = into(final, x, min(scores)[1] if scores else None)
    return final


def forward(tracks, t):
    out, gone = [], set()
    for i, x in enumerate(tracks):
        if i not in gone:
            for j in range(i + 1, len(tracks)):
                r, c = likeness(x, tracks[j])
                if j not in gone and r >= t.split_reid and c >= t.split_color:
                    x = x + tracks[j]
                    gone.add(j)
            out.append(x)
    return out


def running(groups, t):
    final = []
    for g in groups:
        final = into(final, g, choose(g, final, t.merge_reid, t.merge_color, t.merge_weight, t.max_overlap))
    return final


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inner = max(0, w) * max(0, h)
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
    return inner / both if both > 0 else 0.0


def scaled(v):
    return v / np.linalg.norm(v)


def link(frames, t, short, stale):
    """frames: (frame, [(local, box, ok, vector, up, lo)]). (gid, reason) for each detection; the corrected habits only."""
    people, tracks, out = {}, {}, []
    for frame, rows in frames:
        used = set()
        for local, box, ok, emb, up, lo in rows:
            track = tracks.get(local)

            def born(reason, vectors, box=box, local=local, frame=frame, used=used):
                gid = len(people) + 1
                people[gid] = {"v": None, "n": 0, "at": frame, "box": box}
                if vectors:
                    people[gid] |= {"v": scaled(vectors[0]), "u": vectors[1], "l": vectors[2], "n": 1}
                tracks[local] = {"gid": gid, "at": frame, "fresh": frame if vectors else None}
                used.add(gid)
                out.append((gid, reason))

            def taught(p, emb=emb, up=up, lo=lo):
                if p["v"] is None:
                    p |= {"v": scaled(emb), "u": up, "l": lo}
                else:
                    u, low = ((1 - t.color_alpha) * p[k] + t.color_alpha * x for k, x in (("u", up), ("l", lo)))
                    p |= {"v": scaled((1 - t.prototype_alpha) * p["v"] + t.prototype_alpha * emb), "u": u / u.sum(), "l": low / low.sum()}
                p["n"] += 1

            alike = lambda p, up=up, lo=lo: 0.4 * np.minimum(p["u"], up).sum() + 0.6 * np.minimum(p["l"], lo).sum()
            if not ok:
                if track is None:
                    born("new (no reid)", None)
                else:
                    people[track["gid"]] |= {"at": frame, "box": box}
                    track["at"] = frame
                    used.add(track["gid"])
                    out.append((track["gid"], "updated without reid"))
                continue
            if track is None:
                ranked = []
                for gid, p in people.items():
                    if p["v"] is not None and alike(p) >= t.color_floor:
                        near = frame - p["at"] <= short
                        score = float(p["v"] @ emb) + (t.iou_weight * iou(box, p["box"]) if near else 0)
                        if score >= (t.short_link if near else t.long_link):
                            ranked.append((-score, gid))
                ranked.sort()
                clear = ranked and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= t.ambiguity_margin)
                if clear and ranked[0][1] not in used:
                    gid = ranked[0][1]
                    taught(people[gid])
                    people[gid] |= {"at": frame, "box": box}
                    tracks[local] = {"gid": gid, "at": frame, "fresh": frame}
                    used.add(gid)
                    out.append((gid, "re-linked"))
                else:
                    born("new", (emb, up, lo))
                continue
            p, due = people[track["gid"]], track["fresh"] is None or frame - track["fresh"] >= t.embed_every
            if due and p["v"] is not None and (float(p["v"] @ emb) < t.drift_reid or alike(p) < t.drift_color):
                born("split", (emb, up, lo))
            elif track["gid"] in used:
                if not due:
                    p |= {"at": frame, "box": box}
                born("same-frame conflict", (emb, up, lo))
            else:
                reason = "stub initialised" if due and p["v"] is None else "updated"
                if due:
                    taught(p)
                    track["fresh"] = frame
                p |= {"at": frame, "box": box}
                track["at"] = frame
                used.add(track["gid"])
                out.append((track["gid"], reason))
        tracks = {k: v for k, v in tracks.items() if frame - v["at"] <= stale}
    return out
