"""Planners: from key loads to placements."""
