"""Files from a URL, with a check of their digest, repeats and a second address."""

from __future__ import annotations

import hashlib
import logging
import os
import shutil
import time
import urllib.error
import urllib.request

from lociq.errors import ConfigError

LOG = logging.getLogger("lociq")
#: Seconds waited before each repeat.
WAITS = (10, 100)


def digest(path: str) -> str:
    out = hashlib.md5()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            out.update(part)
    return out.hexdigest()


def fetch(addresses: list[str], target: str, md5: str | None = None, waits: tuple[float, ...] = WAITS) -> str:
    """Copies the first address that answers with the right file to target; a file that is right already is kept."""
    if md5 and os.path.exists(target) and digest(target) == md5:
        return target
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    for address in addresses:
        for wait in (*waits, None):
            try:
                part = f"{target}.part"
                with urllib.request.urlopen(address, timeout=60) as source, open(part, "wb") as out:
                    shutil.copyfileobj(source, out)
                if md5 and digest(part) != md5:
                    os.remove(part)
                    raise OSError("the file's digest is not the one expected")
                os.replace(part, target)
                return target
            except (urllib.error.URLError, OSError) as e:
                LOG.warning("%s could not be read: %s", address, e)
                if wait is not None:
                    time.sleep(wait)
    raise ConfigError(f"{os.path.basename(target)} could not be fetched")
