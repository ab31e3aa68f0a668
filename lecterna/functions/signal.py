"""Audio features and activity detection in NumPy, for use in Arrow batches."""

from __future__ import annotations

import numpy as np

RATE = 16_000


def window(kind: str, n: int) -> np.ndarray:
    a = 2 * np.pi * np.arange(n) / (n - 1)
    if kind == "hanning":
        return 0.5 - 0.5 * np.cos(a)
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(a)
    if kind == "povey":
        return (0.5 - 0.5 * np.cos(a)) ** 0.85
    if kind == "blackman":
        return 0.42 - 0.5 * np.cos(a) + 0.08 * np.cos(2 * a)
    if kind == "rectangular":
        return np.ones(n)
    raise ValueError(f"no window {kind}")


def framed(x: np.ndarray, size: int = 400, hop: int = 160, *, snip: bool = True) -> np.ndarray:
    """(frames, size): whole frames only, or as many as hops with mirrored edges."""
    if snip:
        n = 1 + (len(x) - size) // hop if len(x) >= size else 0
        return np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n] if n else np.zeros((0, size))
    n = (len(x) + hop // 2) // hop
    pad = (size - hop) // 2
    y = np.concatenate([x[:pad][::-1], x, x[::-1][: size]])
    return np.lib.stride_tricks.sliding_window_view(y, size)[::hop][:n]


def mel(f: np.ndarray | float) -> np.ndarray:
    return 1127.0 * np.log1p(np.asarray(f) / 700.0)


def warped(f: np.ndarray, warp: float, *, low: float, high: float, from_: float = 100.0, to: float = 7500.0) -> np.ndarray:
    """Frequencies warped for the length of a vocal tract: by 1/``warp`` in the
    middle, linearly towards the ends of the band, which stay."""
    f = np.asarray(f, float)
    lower, upper = from_ * max(1.0, warp), to * min(1.0, warp)
    left, right = (lower / warp - low) / (lower - low), (high - upper / warp) / (high - upper)
    return np.where((f < low) | (f > high), f, np.where(f < lower, low + left * (f - low), np.where(f < upper, f / warp, high + right * (f - high))))


def mel_bank(bins: int, fft: int, *, rate: int = RATE, low: float = 20.0, high: float = 0.0, warp: float = 1.0) -> np.ndarray:
    """(bins, fft/2+1) triangles evenly spaced on the mel scale, warped by ``warp``."""
    top = high if high > 0 else rate / 2 + high
    edges = np.linspace(mel(low), mel(top), bins + 2)
    if warp != 1.0:
        edges = mel(warped(700.0 * np.expm1(edges / 1127.0), warp, low=low, high=top))
    m = mel(np.arange(fft // 2 + 1) * rate / fft)[None]
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((m - left) / (centre - left), (right - m) / (right - centre)))
    bank[:, -1] = 0
    return bank


def fbank(x: np.ndarray, *, bins: int = 80, size: int = 400, hop: int = 160, kind: str = "hamming", emphasis: float = 0.97, dither: float = 0.0, seed: int = 42, snip: bool = True, mean: bool = False) -> np.ndarray:
    """(frames, bins) log mel energies: offset removed, pre-emphasis, window,
    power spectrum, mel bank, logarithm."""
    f = framed(np.asarray(x, float), size, hop, snip=snip).copy()
    if not len(f):
        return np.zeros((0, bins), np.float32)
    if dither:
        f += dither * np.random.default_rng(seed).standard_normal(f.shape)
    f -= f.mean(1, keepdims=True)
    f -= emphasis * np.concatenate([f[:, :1], f[:, :-1]], 1)
    fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(f * window(kind, size), fft)) ** 2
    out = np.log(np.maximum(power @ mel_bank(bins, fft).T, np.finfo(np.float32).eps))
    return (out - out.mean(0) if mean else out).astype(np.float32)


def stacked(f: np.ndarray, m: int = 7, n: int = 6) -> np.ndarray:
    """Low frame rate: m frames in one, every n; edges repeated."""
    if not len(f):
        return np.zeros((0, f.shape[1] * m), f.dtype)
    at = np.arange(0, len(f), n)[:, None] + np.arange(m)[None] - (m - 1) // 2
    return f[np.clip(at, 0, len(f) - 1)].reshape(len(at), -1)


def cmvn(f: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (f + shift) * scale


def decibel(frames: np.ndarray) -> np.ndarray:
    return 10 * np.log10((np.asarray(frames, float) ** 2).sum(1) + 1e-6)


def loudness(x: np.ndarray, share: float = 0.1, offset: float = 1e-4) -> float:
    """Mean of the largest ``share`` of the positive samples (all of them if there are fewer than ten), to five places."""
    if len(x) <= 100:
        return offset
    p = np.sort(x[x > 0])
    k = int(len(p) * share)
    p = p[-k:] if k else p
    return round(float(p.mean()), 5) + offset if len(p) else offset


def slices_4class(x: np.ndarray, *, rate: int = RATE, extra: int = 240, most: int = 5) -> list[np.ndarray]:
    """Batches of up to ``most`` one-second slices, each wrapped to two seconds and a margin."""
    n = max(1, int(np.ceil(len(x) / rate)))
    rows = [np.resize(x[i * rate : (i + 1) * rate], 2 * rate + extra) for i in range(n) if len(x[i * rate : (i + 1) * rate])]
    return [np.stack(rows[i : i + most]) for i in range(0, len(rows), most)]


# Fixed values of the mute rule: how much louder the loud part is, the floor of loudness, how far above the quietest,
# and the jump between neighbours from which a frame isn't mute.
MUTE_RATIO, MUTE_FLOOR, MUTE_ABOVE, MUTE_JUMP = 8.0, 0.00305, 1.3, 3.0


def mute_runs(x: np.ndarray, *, hop: int = 160) -> list[tuple[int, int]]:
    """Voiced runs (first, last frame) of a piece of audio whose quiet ends are muted.

    A frame is mute if the loud part is eight times louder, or if it is near
    the quietest. Any mute frame but the first one is voiced where the loudness
    jumps, up or down, against the frame before. A mute frame at an end beside a voiced
    one is voiced, and so are mute frames between voiced ones."""
    n = len(x) // hop
    if not n:
        return []
    s = np.abs(np.asarray(x[: n * hop], float)).reshape(n, hop)
    # each frame is smoothed by itself
    pad = np.pad(s, ((0, 0), (1, 1)))
    loud = ((pad[:, :-2] + pad[:, 1:-1] + pad[:, 2:]) / 3).max(1)
    pos = np.sort(loud[loud > 0])
    if not len(pos):
        return []
    k = int(len(pos) * 0.3)
    base = round(float((pos[-k:] if k else pos).mean()), 5)
    mute = (base / (loud + 1e-5) >= MUTE_RATIO) | (loud < max(MUTE_FLOOR, MUTE_ABOVE * loud.min()))
    later = np.nonzero(mute)[0][1:]
    high, low = np.maximum(loud[later - 1], loud[later]), np.minimum(loud[later - 1], loud[later])
    mute[later[high / (low + 1e-5) > np.minimum(1.1 * base / (6 * loud[later] + 1e-5), MUTE_JUMP)]] = False
    if n > 1:
        mute[0] &= mute[1]
        mute[-1] &= mute[-2]
    voiced = np.nonzero(~mute)[0]
    return [(int(voiced[0]), int(voiced[-1]))] if len(voiced) else []


def tightened(x: np.ndarray, start: float, end: float, *, least: float = 0.5, hop: int = 160, rate: int = RATE) -> tuple[float, float]:
    """A segment's times cut to its voiced part, at least ``least`` seconds long within its end."""
    runs = mute_runs(x, hop=hop)
    if not runs:
        return start, end
    a = round(start + runs[0][0] * hop / rate, 2)
    b = round(start + (runs[0][1] + 1) * hop / rate, 2)
    return a, min(max(b, a + least), end)


class ActivityDetector:
    """Speech segments from frame scores, frame by frame; the same core serves
    batch and stream. Times in ms; frames are 10 ms.

    A ring of ``ring`` frames switches to speech when ``to_speech`` of them are
    voiced and back when no more than ``to_silence`` are. A segment opens
    ``look_back`` frames and a ring before the switch, closes when silence has
    lasted ``end_silence`` (keeping ``look_ahead`` of it) or at ``most``. A frame less
    than ``least_snr`` decibels above the noise so far is no speech."""

    FIELDS = ("frame", "ring_bits", "speaking", "open", "start", "silence", "noise", "floor")

    def __init__(self, *, ring: int = 20, to_speech: int = 15, to_silence: int = 15, look_back: int = 20, look_ahead: int = 10, end_silence: int = 80, most: int = 6000, ratio: float = 1.0, margin: float = 0.6, least_db: float = -100.0, least_snr: float = -100.0, noise_frames: int = 100) -> None:
        self.ring, self.to_speech, self.to_silence, self.look_back, self.look_ahead, self.end_silence, self.most = ring, to_speech, to_silence, look_back, look_ahead, end_silence, most
        self.ratio, self.margin, self.least_db, self.least_snr, self.noise_frames = ratio, margin, least_db, least_snr, noise_frames
        self.frame, self.ring_bits, self.speaking, self.open, self.start, self.silence, self.noise, self.floor = 0, [0] * ring, False, False, 0, 0, None, 0

    def state(self) -> dict:
        return {k: getattr(self, k) for k in self.FIELDS}

    def restore(self, state: dict) -> ActivityDetector:
        for k, v in state.items():
            setattr(self, k, v)
        return self

    def voiced(self, silence_score: float, db: float) -> bool:
        if db < self.least_db:
            return False
        yes = (1 - silence_score) >= silence_score**self.ratio + self.margin
        if not yes:
            # the noise is a running mean of what isn't speech
            self.noise = db if self.noise is None else (db + self.noise * (self.noise_frames - 1)) / self.noise_frames
            return False
        return db - (self.noise if self.noise is not None else -100.0) >= self.least_snr

    def push(self, silence_score: float, db: float = 0.0) -> tuple[int, int] | None:
        """The segment (start, end) that this frame closes, if any."""
        bit = int(self.voiced(silence_score, db))
        self.ring_bits[self.frame % self.ring] = bit
        total = sum(self.ring_bits)
        cur = self.frame
        self.frame += 1
        if not self.speaking and total >= self.to_speech:
            self.speaking, self.silence = True, 0
            if not self.open:
                self.open, self.start = True, max(self.floor, cur - self.ring - self.look_back)
        elif self.speaking and total <= self.to_silence and not bit:
            self.speaking = False
        if not self.open:
            return None
        if self.speaking:
            self.silence = 0
        else:
            self.silence += 1
        if cur - self.start + 1 >= self.most:
            return self._close(cur)
        if self.silence >= self.end_silence - self.to_silence:
            return self._close(max(self.start, cur - max(0, self.end_silence - self.look_ahead - 1 - self.to_silence)))
        return None

    def finish(self) -> tuple[int, int] | None:
        """The segment still open at the end."""
        return self._close(self.frame - 1) if self.open else None

    def _close(self, last: int) -> tuple[int, int]:
        got = (self.start * 10, (last + 1) * 10)
        self.open, self.speaking, self.silence, self.floor = False, False, 0, last + 1
        self.ring_bits = [0] * self.ring
        return got


class OnlineFbank:
    """Log mel energies of audio that comes in pieces: frames are given once all
    their samples are there, the rest is kept. The frames are those of ``fbank``."""

    def __init__(self, *, size: int = 400, hop: int = 160, **how: object) -> None:
        self.size, self.hop, self.how, self.rest = size, hop, how, np.zeros(0)

    def accept(self, x: np.ndarray) -> np.ndarray:
        self.rest = np.concatenate([self.rest, np.asarray(x, float)])
        out = fbank(self.rest, size=self.size, hop=self.hop, **self.how)
        self.rest = self.rest[len(out) * self.hop :]
        return out

    def reset(self) -> None:
        self.rest = np.zeros(0)
