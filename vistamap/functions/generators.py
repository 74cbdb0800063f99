"""Random numbers with a defined sequence, so that a selection can be repeated anywhere."""

from __future__ import annotations

import math

import numpy as np


class Drand48:
    """The 48-bit linear congruential generator of POSIX."""

    # fixed values: multiplier and increment of the standard
    TIMES, PLUS = 0x5DEECE66D, 0xB

    def __init__(self, seed: int = 12345):
        self.x = ((seed & 0xFFFFFFFF) << 16) | 0x330E

    def __call__(self) -> float:
        self.x = (self.TIMES * self.x + self.PLUS) & ((1 << 48) - 1)
        return self.x / (1 << 48)


    def jump(self, n: int) -> Drand48:
        """The generator after n more draws, by repeated squaring of its step."""
        times, plus, mask = self.TIMES, self.PLUS, (1 << 48) - 1
        while n:
            if n & 1:
                self.x = (times * self.x + plus) & mask
            plus, times, n = (times * plus + plus) & mask, times * times & mask, n >> 1
        return self

    def take(self, n: int) -> np.ndarray:
        """The next n draws."""
        return np.array([self() for _ in range(n)])


class Twister:
    """MT19937, 32 bits a draw, as a fraction of 2**32."""

    def __init__(self, seed: int = 5489):
        self.bits = np.random.RandomState(seed)

    def __call__(self) -> float:
        return int(self.bits.randint(0, 1 << 32, dtype=np.uint32)) / 2**32


class Gaussian:
    """Normal deviates by the polar method; the second of each pair is kept for the next call."""

    def __init__(self, uniform, mean: float = 0.0, deviation: float = 1.0):
        self.uniform, self.mean, self.deviation, self.spare = uniform, mean, deviation, None

    def __call__(self) -> float:
        if self.spare is not None:
            z, self.spare = self.spare, None
            return self.mean + self.deviation * z
        while True:
            u, v = 2 * self.uniform() - 1, 2 * self.uniform() - 1
            s = u * u + v * v
            if 0 < s < 1:
                break
        k = math.sqrt(-2 * math.log(s) / s)
        self.spare = v * k
        return self.mean + self.deviation * u * k


def correlated(gaussian, acf: np.ndarray, n: int) -> np.ndarray:
    """n values of a stationary Gaussian process whose autocorrelation follows `acf` (lags 0 ..): white noise through the
    symmetric filter whose spectrum is the square root of the process's."""
    full = np.concatenate([acf, acf[-2:0:-1]]) if len(acf) > 1 else acf
    kernel = np.fft.fftshift(np.fft.ifft(np.sqrt(np.maximum(np.fft.fft(full).real, 0))).real)
    noise = np.array([gaussian() for _ in range(n + len(kernel) - 1)])
    return np.convolve(noise, kernel, "valid")
