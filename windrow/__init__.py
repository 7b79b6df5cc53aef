"""Copy detection over large collections of code and text, on Spark DataFrames."""

__version__ = "0.1.0"
__all__ = ["Config", "Detector", "compare", "fingerprint"]


def __getattr__(name: str):
    if name == "Config":
        from windrow.config import Config

        return Config
    if name in ("Detector", "compare"):
        from windrow.plans import detector

        return getattr(detector, name)
    if name == "fingerprint":
        from windrow.operators.fingerprint import fingerprint

        return fingerprint
    raise AttributeError(name)
