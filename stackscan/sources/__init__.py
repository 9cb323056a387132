"""Readers and writers for signature files, pages, snapshots and scan stores."""
