"""Part of sheafline; see README.md."""
