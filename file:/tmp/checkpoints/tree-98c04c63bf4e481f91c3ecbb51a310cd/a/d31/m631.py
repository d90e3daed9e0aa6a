x631