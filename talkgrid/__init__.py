"""DataFrame operators for time-stamped media: chunks, frames, vectors, ranked lists."""

__version__ = "0.1.0"
