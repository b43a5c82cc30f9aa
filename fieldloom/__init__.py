"""fieldloom: a PySpark-native engine for gridded, point and time-series geoscience data."""

__version__ = "0.1.0"

from fieldloom.core.cube import DataCube  # noqa: E402
from fieldloom.core.dataset import Dataset  # noqa: E402
from fieldloom.core.domain import Domain, DomainType, GeodeticGrid, GeodeticPoints  # noqa: E402
from fieldloom.core.field import Field  # noqa: E402
from fieldloom.sources.catalog import open_datacube, open_dataset  # noqa: E402

__all__ = ["DataCube", "Dataset", "Domain", "DomainType", "Field", "GeodeticGrid", "GeodeticPoints", "open_datacube", "open_dataset"]
