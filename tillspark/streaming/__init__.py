from .scoring import append_log, read_log, score_stream

__all__ = ["append_log", "read_log", "score_stream"]
