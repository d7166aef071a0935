"""Senders that write requests to a folder instead of the network."""

import json
import os
import uuid


def accept(url, headers, body, timeout):
    folder = headers["Authorization"].removeprefix("Bearer ")
    name = uuid.uuid4().hex
    with open(os.path.join(folder, name + ".bin"), "wb") as f:
        f.write(body)
    with open(os.path.join(folder, name + ".json"), "w") as f:
        json.dump({"url": url, "headers": headers}, f)
    return 204


def refuse(url, headers, body, timeout):
    return 400
