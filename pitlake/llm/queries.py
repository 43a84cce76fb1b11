"""The training-data queries: importing the modules registers them."""

from . import chat, clustering, decontaminate, jaccard_join, language, licence_scan, mixing, quality_rules, repair, secret_scan, site_quality, toxicity, url_filter  # noqa: F401
from .common import QUERIES  # noqa: F401
from .oracles import ORACLES  # noqa: F401
