"""Usage metering and verifiable billing as Spark DataFrame transformations."""

from sealbook.settings import Settings

__all__ = ["Settings"]
