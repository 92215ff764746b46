"""Secret scans: a character convolutional network in numpy over every candidate and its surroundings.

Candidates are found in the bytes of whole texts:

* runs of the characters that keys are made of, at least MIN_RUN long with a digit among them;
* values behind ``=`` or ``:``, over any blanks: what stands in quotes, or else all up to white space without closing signs; of at
  least MIN_VALUE bytes, or of MIN_NAMED behind a name that speaks of secrets;
* the bodies of PEM private keys.

A run inside of a value that is hardly longer isn't given apart.  The network reads BEFORE bytes of
context, WIDTH bytes of the candidate and AFTER bytes behind; a longer candidate is read in several windows, of which the
best counts.  Bytes and their part (context or candidate) are embedded, convolved, rectified and pooled for each part.

It is trained on labelled findings that ``findings`` writes from a fixed seed: keys, tokens, PEM bodies and passwords of many kinds
in prose and configuration, against commit and file hashes, UUIDs, addresses, numbers, placeholders, certificates and long words.  A
logistic curve fitted on a part that training didn't see calibrates its scores, and the threshold is the highest at
which that part's recall is at least RECALL; a held-out secret that isn't found as a candidate counts as missed.

Training takes about ten seconds of the driver, once for a Python session; it depends on the seed only.
"""

from __future__ import annotations

import base64
import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow

MIN_RUN, MIN_VALUE, MIN_NAMED, BEFORE, WIDTH, AFTER, RECALL, SEED = 16, 8, 4, 32, 64, 16, 0.98, 8
TRAIN, HELD, EPOCHS, EMBED, FILTERS, SPAN = 6_000, 2_000, 6, 10, 32, 5
LENGTH = BEFORE + WIDTH + AFTER
SCHEMA = "doc_id bigint, start bigint, length bigint, score double, secret boolean"
KEY = np.zeros(256, bool)
KEY[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-."]] = True
BLANK, SPACE, CLOSING = (np.isin(np.arange(256), list(x)) for x in (b" \t>", b" \t\r\n\v\f", b",;)]}\"'`.>"))
_NAMED = re.compile(rb"(?i)(?:pass(?:w(?:or)?d|phrase|code)?|pwd|pw|secret|token|api[_-]?key|apikey|auth|credentials?|private|_key|key)[\"'`]?[ \t]*$")
_PEM = re.compile(rb"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----")


def candidates(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each candidate, in order."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    start, end, row = K.words(data, off, KEY)
    end = end - (data[end - 1] == 46) if len(end) else end  # a full stop behind isn't part of it
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57), dtype=np.int32)])
    long = (end - start >= MIN_RUN) & (digits[end] > digits[start])
    start, end, row = start[long], end[long], row[long]
    vs, ve, vr = _values(data, off)
    ps, pe, pr = _pem(data, off)
    vs, ve, vr = (np.concatenate(x) for x in ((vs, ps), (ve, pe), (vr, pr)))
    order = np.lexsort((-ve, vs))
    vs, ve, vr = vs[order], ve[order], vr[order]
    fresh = np.ones(len(vs), bool)
    fresh[1:] = (vs[1:] != vs[:-1]) | (ve[1:] != ve[:-1])
    vs, ve, vr = vs[fresh], ve[fresh], vr[fresh]
    if len(vs):
        # a run in the value that begins last before it, of at least two thirds of its length, is that value
        at = np.searchsorted(vs, start, "right") - 1
        inside = (at >= 0) & (end <= ve[np.maximum(at, 0)]) & (3 * (end - start) >= 2 * (ve - vs)[np.maximum(at, 0)])
        start, end, row = start[~inside], end[~inside], row[~inside]
    start, end, row = (np.concatenate(x) for x in ((start, vs), (end, ve), (row, vr)))
    order = np.lexsort((end, start))
    return start[order], end[order], row[order]


def _values(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values behind signs of assignment, within their line."""
    n = len(data)
    sign = np.flatnonzero((data == 61) | (data == 58))
    row = np.searchsorted(off, sign, "right") - 1
    full = np.flatnonzero(~BLANK[data] & (data != 61))
    at = np.searchsorted(full, sign + 1)
    start = np.where(at < len(full), full[np.minimum(at, len(full) - 1)] if len(full) else n, n)
    line = np.flatnonzero(data == 10)
    stop = np.minimum(np.append(line, n)[np.searchsorted(line, sign)], off[row + 1])  # the end of the sign's line
    keep = start < stop
    sign, row, start, stop = sign[keep], row[keep], start[keep], stop[keep]
    space = np.append(np.flatnonzero(SPACE[data]), n)
    end = np.minimum(space[np.searchsorted(space, start)], stop)
    quoted = np.zeros(len(start), bool)
    for q in b"\"'`":
        own = np.flatnonzero(data[start] == q)
        marks = np.append(np.flatnonzero(data == q), n)
        close = marks[np.searchsorted(marks, start[own] + 1)]
        ok = close < stop[own]
        own, close = own[ok], close[ok]
        start[own] += 1
        end[own] = close
        quoted[own] = True
    bare = ~quoted
    while True:  # closing signs behind, and a quote that isn't closed before
        cut = bare & (end > start) & CLOSING[data[np.maximum(end - 1, 0)]]
        if not cut.any():
            break
        end = end - cut
    start = start + (bare & (start < end) & np.isin(data[np.minimum(start, n - 1)], list(b"\"'`([{")))
    # what stands before an @ in a value that goes on behind it, as in an address with a password
    mail = np.append(np.flatnonzero(data == 64), n)
    close = mail[np.searchsorted(mail, start)]
    cut = np.flatnonzero(bare & (close > start) & (close < end))
    sign, row, start, end = (np.concatenate([x, y]) for x, y in ((sign, sign[cut]), (row, row[cut]), (start, start[cut]), (end, close[cut])))
    size = end - start
    named = np.zeros(len(start), bool)
    for i in np.flatnonzero((size >= MIN_NAMED) & (size < MIN_VALUE)):
        named[i] = _NAMED.search(data[max(int(off[row[i]]), int(sign[i]) - 40) : sign[i]].tobytes()) is not None
    keep = (size >= MIN_VALUE) | named
    return start[keep], end[keep], row[keep]


def _pem(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bodies of private keys, up to their end mark or the end of the row."""
    raw = data.tobytes()
    found = []
    for m in _PEM.finditer(raw):
        row = int(np.searchsorted(off, m.start(), "right")) - 1
        end = raw.find(b"-----END", m.end(), int(off[row + 1]))
        found.append((m.end(), end if end >= 0 else int(off[row + 1]), row))
    made = np.array([x for x in found if x[1] > x[0]], np.int64).reshape(-1, 3)
    return made[:, 0], made[:, 1], made[:, 2]


def windows(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, part, candidate) of each window: uint8 arrays of LENGTH columns; outside of the row bytes are 0."""
    many = np.maximum(1, -(-(end - start) // WIDTH))
    which = np.repeat(np.arange(len(start)), many)
    k = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    lo = start[which] + k * WIDTH
    hi = np.minimum(lo + WIDTH, end[which])
    col = np.arange(LENGTH)[None, :]
    inside = col - BEFORE
    size = (hi - lo)[:, None]
    part = np.where(inside < 0, 1, np.where(inside < size, 2, np.where((inside >= WIDTH), 3, 0))).astype(np.uint8)
    place = np.where(inside < WIDTH, lo[:, None] + inside, hi[:, None] + inside - WIDTH)
    ok = (part > 0) & (place >= off[row[which]][:, None]) & (place < off[row[which] + 1][:, None])
    raw = np.where(ok, data[np.clip(place, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)
    return np.minimum(raw, 128), np.where(ok, part, 0).astype(np.uint8), which


@dataclass
class Network:
    """Weights of the network, its calibration (slope, shift) and threshold."""

    chars: np.ndarray
    parts: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, raw: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.chars[raw] + self.parts[part]
        cols = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1)  # n, places, embed, span
        n, places = cols.shape[:2]
        cols = cols.reshape(n, places, EMBED * SPAN)
        a = np.maximum(cols.reshape(-1, EMBED * SPAN) @ self.conv + self.bias, 0).reshape(n, places, FILTERS)
        mid = part[:, SPAN // 2 : SPAN // 2 + places]
        pooled, arg = [], []
        for p in (1, 2, 3):
            masked = np.where((mid == p)[:, :, None], a, 0)
            ix = masked.argmax(1)
            arg.append(ix)
            pooled.append(np.take_along_axis(masked, ix[:, None, :], 1)[:, 0])
        share = ((mid == 2) / np.maximum((mid == 2).sum(1, keepdims=True), 1)).astype(a.dtype)
        pooled.append(np.einsum("np,npf->nf", share, a))
        x = np.concatenate([*pooled, np.ones((n, 1), a.dtype)], 1)
        return x @ self.out, (cols, a, mid, arg, share, x)

    def backward(self, raw: np.ndarray, part: np.ndarray, kept: tuple, dz: np.ndarray) -> list[np.ndarray]:
        cols, a, mid, arg, share, x = kept
        n, places = a.shape[:2]
        dx = dz[:, None] * self.out[None, :]
        da = np.zeros_like(a)
        rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for i, p in enumerate((1, 2, 3)):
            da[rows, arg[i], filters] += np.where(mid[rows, arg[i]] == p, dx[:, i * FILTERS : (i + 1) * FILTERS], 0)
        da += share[:, :, None] * dx[:, None, 3 * FILTERS : 4 * FILTERS]
        da *= a > 0
        flat = da.reshape(-1, FILTERS)
        dconv = cols.reshape(-1, EMBED * SPAN).T @ flat
        dcols = (flat @ self.conv.T).reshape(n, places, EMBED, SPAN)
        de = np.zeros((n, LENGTH, EMBED), a.dtype)
        for s in range(SPAN):
            de[:, s : s + places] += dcols[:, :, :, s]
        de = de.reshape(-1, EMBED)
        dchars, dparts = np.zeros_like(self.chars), np.zeros_like(self.parts)
        for e in range(EMBED):
            dchars[:, e] = np.bincount(raw.ravel(), de[:, e], 129)
            dparts[:, e] = np.bincount(part.ravel(), de[:, e], 4)
        return [dchars, dparts, dconv, flat.sum(0), x.T @ dz]

    def score(self, raw: np.ndarray, part: np.ndarray) -> np.ndarray:
        z = [self.forward(raw[i : i + 512], part[i : i + 512])[0] for i in range(0, len(raw), 512)]
        z = np.concatenate(z) if z else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


_SYLLABLES = "the ing er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que de la ción ich ein ung ment eau ère ß ö".split()
_NAMES = "token api_key apikey secret client_secret access_token auth_token password passwd pwd db_password private_key aws_secret_access_key secret_key session_secret API_KEY SECRET_TOKEN bearer credential".split()
_B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Labelled findings (text before, candidate, text behind, 1 if secret)."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa = lambda k: pick("0123456789abcdef", k)
    word = lambda lo=1, hi=4: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(lo, hi)))
    prose = lambda k: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(k))
    b64 = lambda k: base64.b64encode(r.randbytes(k)).decode().rstrip("=")
    uuid = lambda: "-".join(hexa(k) for k in (8, 4, 4, 4, 12))

    def assigned() -> tuple[str, str]:
        name, sign, q = r.choice(_NAMES), r.choice([" = ", "=", ": ", ":", " => "]), r.choice(['"', "'", "", '"'])
        return (q + name + q if q and r.random() < 0.2 else name) + sign + q, q

    def secret() -> tuple[str, str, str]:
        k = r.randrange(12)
        if k == 9:  # a private key
            kind = r.choice(["RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED "])
            return f"-----BEGIN {kind}PRIVATE KEY-----", "\n" + "\n".join(b64(48) for _ in range(r.randint(1, 4))) + "\n", f"-----END {kind}PRIVATE KEY-----"
        if k == 10:  # a password with signs
            before, q = assigned()
            value = list(word(1, 2) + pick(_B62, r.randint(2, 8)) + pick("!@#$%^&*?~+-=_.", r.randint(1, 4)))
            r.shuffle(value)
            return before, "".join(value), q
        if k == 11:  # a short one
            name = r.choice(["password", "passwd", "pwd", "pass", "PASSWORD", "db_password", "secret"])
            return name + r.choice(["=", ": ", ":\t", " = ", ":      "]), word(1, 1)[:4] + pick("0123456789", r.randint(1, 3)) + r.choice(["", "!", "#", "$"]), r.choice(["", "\n"])
        if k < 4:
            before, q = assigned()
            value = r.choice([lambda: hexa(r.choice([32, 40, 48, 64])), lambda: pick(_B62, r.randint(20, 48)), lambda: b64(r.randint(18, 40)), lambda: pick(_B62 + "_-", r.randint(12, 32)), lambda: hexa(40)])()
            return before, value, q
        if k == 4:
            return r.choice(["", "key ", "id ", "use "]), "AKIA" + pick(_B62[:26] + _B62[52:], 16), r.choice(["", ",", "."])
        if k == 5:
            return r.choice(["", "with ", "token "]), r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "sk-", "xoxb-", "npm_", "AIza"]) + pick(_B62, r.randint(24, 40)), r.choice(["", " ", "."])
        if k == 6:
            return r.choice(["Authorization: Bearer ", "bearer ", "jwt="]), "eyJ" + b64(24) + ".eyJ" + b64(40) + "." + b64(32), ""
        if k == 7:
            return r.choice(["postgres://", "https://", "redis://"]) + word() + ":", pick(_B62, r.randint(10, 20)), "@" + word() + ".example.com"
        before, q = assigned()
        return before, word(1, 2).capitalize() + str(r.randint(10, 9999)) + r.choice(["-", "_", "."]) + pick(_B62, r.randint(3, 8)), q

    def other() -> tuple[str, str, str]:
        k = r.randrange(14)
        if k == 12:  # a certificate or public key, and what isn't a value
            kind = r.choice(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY"])
            return f"-----BEGIN {kind}-----\n", b64(48), "\n"
        if k == 13:
            return r.choice(["note: ", "title: ", "Note:\t", "said: ", "label = ", "key: ", "password: ", "secret: "]), '"' + prose(r.randint(1, 4)) + '"' if r.random() < 0.5 else r.choice(["none", "null", "true", "required", "hidden", "********", "<your password>", "${PASSWORD}", "{{ secret }}", "forgotten"]), r.choice(["", " ", "."])
        if k == 0:
            return r.choice(["commit ", "revision ", "sha ", "git checkout ", "tree ", "merge "]), hexa(40), r.choice(["", " ", "."])
        if k == 1:
            return r.choice(["sha256:", "checksum: ", "md5 ", "SHA-1: ", "digest ", "etag: ", "md5sum = "]), hexa(r.choice([32, 40, 64])), ""
        if k == 2:
            return r.choice(["id ", "uuid=", "request_id: ", "urn:uuid:", ""]), uuid(), ""
        if k == 3:
            return r.choice(["https://", "http://www.", "see "]), word() + ".example.com/" + word() + "/" + str(r.randint(1, 99999)), " "
        if k == 4:
            return r.choice(["", "mail ", ": "]), word() + "." + str(r.randint(1, 99)), "@mail" + str(r.randint(1, 9)) + ".example.com"
        if k == 5:
            return r.choice(["", ": ", "= "]), word(5, 9) + (str(r.randint(0, 9999)) if r.random() < 0.4 else ""), r.choice(["", ",", "."])
        if k == 6:
            before, q = assigned()
            return before, r.choice(["changeme", "password", "your-token-here", "xxxxxxxxxxxxxxxx", "REPLACE_ME_1234567", "example-secret", "0000000000000000", "process.env.API_KEY", "os.environ", "undefined", "config.get"]), q
        if k == 7:
            return r.choice(["date: ", "at ", "version = ", "v"]), r.choice([f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T1{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}-beta.{r.randint(1, 9)}-build.{r.randint(1, 999)}"]), ""
        if k == 8:
            return r.choice(["data:image/png;base64,", "src=data:font/woff;base64,"]), b64(r.randint(40, 120)), ""
        if k == 9:
            return r.choice(["call ", "tel: ", "ip: ", "at "]), r.choice([pick("0123456789", 16), ".".join(str(r.randint(100, 255)) for _ in range(4)), f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}-{r.randint(100, 999)}"]), ""
        if k == 10:
            return r.choice(["import ", "def ", "class ", "name: ", "path = "]), "_".join(word() for _ in range(4)) + str(r.randint(1, 99)), "("
        return r.choice(["title: ", "note: ", "label = ", "colour: ", "author: ", "color: #"]), word(3, 6), " "

    out = []
    for i in range(n):
        before, value, behind = secret() if i % 2 else other()
        lead = (prose(r.randint(0, 8)) + r.choice([" ", "\n", " ", "", "### ", "\n  "])) if r.random() < 0.9 else ""
        tail = r.choice([" ", "\n", ", ", "", "### ", "!! ", ";\n"]) + prose(r.randint(0, 5))
        if not (behind + tail)[:1] or (behind + tail)[0].isalnum():
            tail = " " + tail  # a value ends somewhere
        if r.random() < 0.1 and not value.startswith(("ey", "gh", "sk", "xo", "np")):
            lead, before, value, behind, tail = (x.upper() for x in (lead, before, value, behind, tail))
        out.append((lead + before, value, behind + tail, i % 2))
    return out


def prepared(found: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, part, label) of the first window of each finding."""
    raws, parts, y = [], [], []
    for before, value, behind, label in found:
        b, v, e = before.encode(), value.encode(), behind.encode()
        data = np.frombuffer(b + v + e, np.uint8)
        raw, part, _ = windows(data, np.array([0, len(data)]), np.array([len(b)]), np.array([len(b) + len(v)]), np.array([0]))
        raws.append(raw[:1])
        parts.append(part[:1])
        y.append(label)
    return np.concatenate(raws), np.concatenate(parts), np.array(y, float)


def missed(found: list[tuple[str, str, str, int]]) -> np.ndarray:
    """Whether each finding's value is no candidate of its text: one that covers nine tenths of it and is no more than half longer."""
    texts = [(b.encode(), v.strip().encode(), e.encode(), len(v.encode()) - len(v.lstrip().encode())) for b, v, e, _ in found]
    data = np.frombuffer(b"".join(b + b" " * lead + v + e for b, v, e, lead in texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(b) + lead + len(v) + len(e) for b, v, e, lead in texts])])
    start, end, row = candidates(data, off)
    low = off[:-1] + [len(b) + lead for b, _, _, lead in texts]
    high = low + [len(v) for _, v, _, _ in texts]
    over = np.minimum(end, high[row]) - np.maximum(start, low[row])
    good = (10 * over >= 9 * (high - low)[row]) & (2 * (end - start) <= 3 * (high - low)[row] + 8)
    out = np.ones(len(found), bool)
    out[row[good]] = False
    return out


@functools.lru_cache(maxsize=2)
def trained(seed: int = SEED, n: int = TRAIN, epochs: int = EPOCHS) -> Network:
    raw, part, y = prepared(findings(n, seed))
    rng = np.random.default_rng(seed)
    net = Network(*(w.astype(np.float32) for w in (rng.normal(0, 0.3, (129, EMBED)), rng.normal(0, 0.3, (4, EMBED)), rng.normal(0, (2 / (EMBED * SPAN)) ** 0.5, (EMBED * SPAN, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.05, 4 * FILTERS + 1))))
    weights = [net.chars, net.parts, net.conv, net.bias, net.out]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            ids = order[lo : lo + 64]
            z, kept = net.forward(raw[ids], part[ids])
            dz = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[ids]) / len(ids)).astype(np.float32)
            step += 1
            rate = 0.004 * (1 - epoch / (epochs + 1))
            for i, g in enumerate(net.backward(raw[ids], part[ids], kept, dz)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                weights[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    held = findings(HELD, seed + 1)
    raw, part, y = prepared(held)
    z = np.concatenate([net.forward(raw[i : i + 512], part[i : i + 512])[0] for i in range(0, len(raw), 512)])
    a, b = 1.0, 0.0
    for _ in range(300):  # Platt's curve
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        a, b = a - 0.05 * float(((p - y) * z).mean()), b - 0.05 * float((p - y).mean())
    net.slope, net.shift = a, b
    hits = np.sort(np.where(missed(held), 0.0, net.score(raw, part))[y == 1])
    net.threshold = float(min(hits[int((1 - RECALL) * len(hits))], 0.9))
    return net


def scanned(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, start, length, score, secret) of every candidate of every row; start and length count characters.

    A null or empty text has no candidates; a null doc_id stays null; rows that repeat are each scanned.  Candidates of one text that
    overlap are each given.  A text of any length is scanned as a whole, a candidate of any length in windows.  An empty table gives an
    empty result.  Columns other than doc_id and text are not looked at, so their names can't clash."""
    net = net or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column(1))
            for lo, hi in K.slices(off):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                start, end, row = candidates(part, o)
                if not len(start):
                    continue
                best = np.zeros(len(start))
                for a in range(0, len(start), 2048):
                    raw, kind, which = windows(part, o, start[a : a + 2048], end[a : a + 2048], row[a : a + 2048])
                    np.maximum.at(best, which + a, net.score(raw, kind))
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + lo)), pa.array(chars[start] - chars[o[row]]), pa.array(chars[end] - chars[start]), pa.array(best), pa.array(best >= net.threshold)],
                    names=["doc_id", "start", "length", "score", "secret"],
                )

    return arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, SCHEMA)
