"""A plain fold over one entity after the other, row by row: the independent model that the windows are held against.

Instants are whole numbers, OPEN is None. A chain is a sorted list of dicts with vf, vt, op, row.
"""

from collections import Counter


def fold_batch(chains: dict, rows: list, *, late="split", dups="last_wins", deletes="soft", carry=False, tracked=(), columns=()):
    """rows: dicts with key, vf, delete, values (only columns that are present). Returns (emitted, counters); chains is changed in place."""
    counters, emitted = Counter(), []
    groups = {}
    for r in rows:
        groups.setdefault(r["key"], []).append(r)
    for key, own in groups.items():
        chain = chains.setdefault(key, [])
        before = [dict(v) for v in chain]
        own = sorted(own, key=lambda r: r["vf"])
        kept = []
        for r in own:
            if kept and kept[-1]["vf"] == r["vf"]:
                if dups == "reject":
                    counters["rejects"] += 1
                else:
                    kept[-1] = r
            else:
                kept.append(r)
        top = chain[-1]["vf"] if chain else None
        for r in kept:
            place(chain, r, top, counters, late, deletes, carry, tracked, columns)
        for v in chain:
            old = next((b for b in before if b["vf"] == v["vf"]), None)
            if v.pop("new", False) or old is None or old["vt"] != v["vt"]:
                emitted.append((key, v["vf"], v["vt"], v["op"], tuple(v["row"].get(c) for c in columns)))
    return emitted, counters


def place(chain, r, top, counters, late, deletes, carry, tracked, columns):
    vf = r["vf"]
    is_late = top is not None and vf < top
    if is_late and late != "split":
        counters["rejects" if late == "reject" else "quarantined"] += 1
        return
    if r["delete"] and deletes == "ignore":
        counters["no_ops"] += 1
        return
    here = next((v for v in chain if v["vf"] == vf), None)
    before = [v for v in chain if v["vf"] < vf]
    after = [v for v in chain if v["vf"] > vf]
    pred, succ = (before[-1] if before else None), (after[0] if after else None)
    alive = lambda v: v is not None and v["op"] != "DELETE"
    reaches = alive(pred) and (pred["vt"] is None or pred["vt"] > vf or here is not None)
    if r["delete"]:
        if here is not None:
            if not alive(here):
                counters["no_ops"] += 1
                return
            here.update(op="DELETE", new=True)
        elif not alive(pred) or (pred["vt"] is not None and pred["vt"] <= vf):
            counters["no_ops"] += 1
            return
        else:
            chain.append({"vf": vf, "vt": pred["vt"], "op": "DELETE", "row": dict(pred["row"]), "new": True})
            pred["vt"] = vf
            chain.sort(key=lambda v: v["vf"])
        counters["deletes"] += 1
        counters["late_splits"] += is_late
        return
    values = dict(r["values"])
    if carry:
        source = here if here is not None else pred
        if alive(source):
            values = {c: source["row"].get(c) for c in columns} | values
    row = {c: values.get(c) for c in columns}
    same = lambda v: all(v["row"].get(c) == row[c] for c in tracked)
    if here is not None:
        if alive(here) and same(here):
            counters["no_ops"] += 1
            return
        here.update(op="UPDATE" if alive(pred) else "INSERT", row=row, new=True)
        counters["updates"] += 1
    elif reaches and same(pred):
        counters["no_ops"] += 1
        return
    else:
        op = "UPDATE" if reaches else "INSERT"
        chain.append({"vf": vf, "vt": succ["vf"] if succ else None, "op": op, "row": row, "new": True})
        if pred is not None and (pred["vt"] is None or pred["vt"] > vf):
            pred["vt"] = vf
        chain.sort(key=lambda v: v["vf"])
        counters["inserts" if op == "INSERT" else "updates"] += 1
    counters["late_splits"] += is_late
