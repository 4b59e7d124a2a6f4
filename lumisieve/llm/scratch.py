"""The library's scratch tables, under the name that this subpackage's modules use."""

from ..scratch import clear, dropped, new_path, shared_folder, written

__all__ = ["clear", "dropped", "new_path", "shared_folder", "written"]
