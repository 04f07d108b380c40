"""Plain loops over one session's lines: what each rule must return."""

import re


def run(lines, f):
    return [x for x in f([(t, p) for t, p in lines])]


def hit(line, pattern):
    return not line[1] and re.search(pattern, line[0]) is not None


def dedup(lines):
    out = []
    for line in lines:
        if not out or out[-1][0] != line[0]:
            out.append(line)
    return out


def collapse_repeated(lines, pattern, placeholder, least):
    out, run = [], []

    def flush():
        if len(run) >= least:
            out.append((placeholder.replace("{count}", str(len(run))), True))
        else:
            out.extend(run)
        run.clear()

    for line in lines:
        if hit(line, pattern):
            run.append(line)
        else:
            flush()
            out.append(line)
    flush()
    return out


def collapse_between(lines, begin, end, placeholder):
    out, inside, n = [], False, 0
    for line in lines:
        if not inside:
            out.append(line)
            if hit(line, begin):
                inside, n = True, 0
        elif hit(line, end):
            out += [(placeholder.replace("{count}", str(n)), True), line]
            inside = False
        else:
            n += 1
    if inside and n:
        out.append((placeholder.replace("{count}", str(n)), True))
    return out


def head(lines, n):
    return lines[:n]


def tail(lines, n):
    return lines[max(len(lines) - n, 0):]


def first_hit(lines, pattern):
    return next((i for i, x in enumerate(lines) if hit(x, pattern)), None)


def head_after(lines, n, pattern):
    i = first_hit(lines, pattern)
    return lines if i is None else lines[: i + 1 + n]


def tail_before(lines, n, pattern):
    i = first_hit(lines, pattern)
    return lines if i is None else lines[max(i - n, 0):]


def state_machine(lines, states):
    out, now = [], None
    for line in lines:
        if line[1]:
            out.append(line)
            continue
        for s in states:
            if hit(line, s["enter"]):
                now = s
                break
        if now is None:
            out.append(line)
        elif any(hit(line, p) for p in now.get("drop", [])):
            continue
        elif not now.get("keep") or any(hit(line, p) for p in now["keep"]):
            out.append(line)
    return out


def truncate_to(lines, size):
    out, used = [], 0
    for line in lines:
        used += len(line[0].encode()) + 1
        if used > size:
            out.append((f"[... truncated to {size} bytes ...]", True))
            break
        out.append(line)
    return out


def envelope(lines, h, t, tag="gist"):
    if not h and not t:
        return lines
    first, rest = lines[:h], lines[h:]
    last = rest[max(len(rest) - t, 0):] if t else []
    note = [(f"--- [{tag}: middle elided, showing first {h} and last {len(last)} lines] ---", True)]
    return first + (note if h and last else []) + last
