"""Plain Python versions of the semantics, for small inputs."""

from __future__ import annotations

SEND, RECEIVE = "SendTask", "ReceiveTask"


def cases_of(rows):
    """Source tuples by case, in case order (time, missing last, then source order)."""
    cases = {}
    for r in rows:
        if r[1] is not None:
            cases.setdefault((r[0], r[1]), []).append(r)
    for key, events in cases.items():
        events.sort(key=lambda r: (r[4] is None, r[4].timestamp() if r[4] else 0, r[2]))
    return cases


def pairs(events):
    """send index -> receive index, one send after the other."""
    used, found = set(), {}
    for i, s in enumerate(events):
        if s[5] != SEND:
            continue
        for j, r in enumerate(events):
            if r[5] != RECEIVE or j in used:
                continue
            in_time = r[4] >= s[4] if r[4] and s[4] else j > i
            agree = (r[7] is None or s[6] is None or r[7] == s[6]) and \
                (r[8] is None or s[8] is None or r[8] == s[8])
            if in_time and agree:
                found[i] = j
                used.add(j)
                break
    return found


def trace(rows):
    """Executions as lists of event dicts in trace order."""
    out = {}
    for (log, case), events in cases_of(rows).items():
        matched = pairs(events)
        sender_of = {j: i for i, j in matched.items()}
        listed = []
        for i, e in enumerate(events):
            send = i if e[5] == SEND else sender_of.get(i)
            listed.append(dict(
                id=f"e::{case}::{i}", activity=e[3], ts=e[4].timestamp(), actor=e[6] or "",
                send=e[5] == SEND, receive=e[5] == RECEIVE,
                message=None if send is None else f"msg::e::{case}::{send}",
                sender=None if send is None else events[send][6]))
        out[log, case] = sorted(listed, key=lambda e: (e["ts"], e["id"]))
    return out


def label(key, executions, case, i, param):
    events = executions[case]
    later = events[i + 1:]
    e = events[i]
    sends = [x for x in later if x["send"]]
    messages = [x for x in later if x["send"] or x["receive"]]
    by = [x for x in later if x["actor"] == param]
    from_ = lambda x: x["sender"] or x["actor"]
    gap = lambda x: round(x["ts"] - e["ts"], 6)
    first = lambda xs, f: f(xs[0]) if xs else None
    if key == "NE-NEPr":
        return later[0]["activity"]
    if key == "NE-NPaA":
        return later[0]["actor"]
    if key == "NE-NEPa":
        return later[0]["activity"] + "||" + later[0]["actor"]
    if key == "NE-NPaM":
        return first(sends, from_)
    if key == "NE-NMPa":
        return first([x for x in messages if x["actor"] == param], lambda x: x["activity"])
    if key == "NE-NMPr":
        return first(messages, lambda x: x["activity"])
    if key == "NV-PrT":
        return gap(events[-1])
    if key == "NV-PaT":
        return gap(by[-1]) if by else 0.0
    if key == "NV-TNE":
        return gap(later[0])
    if key == "NV-TNM":
        return first(sends, gap)
    if key == "NV-NMPr":
        return float(len(sends))
    if key == "NV-NMPa":
        return float(sum(from_(x) == param for x in sends))
    if key == "OB-P":
        return bool(by)
    if key == "OB-M":
        return any(x["activity"] == param for x in sends)
    if key == "X-MSt":
        if not sends:
            return None
        got = [x for x in events if x["receive"] and x["message"] == sends[0]["message"]]
        return round(got[0]["ts"] - sends[0]["ts"], 6) if got and sends[0]["message"] else None
    if key == "X-PaL":
        if not by:
            return 0.0
        t, n = by[0]["ts"], 0
        for other, xs in executions.items():
            own = [x["ts"] for x in xs if x["actor"] == param]
            n += bool(other != case and own and min(own) <= t <= max(own))
        return float(n)
    raise KeyError(key)


def labels(key, executions, param=None):
    """(case, event, k, y) for every prefix."""
    return [(case[1], events[i]["id"], i + 1, label(key, executions, case, i, param))
            for case, events in executions.items() for i in range(len(events) - 1)]
