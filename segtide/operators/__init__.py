"""DataFrame operators over catalogues, schedules, samples and playlists."""
