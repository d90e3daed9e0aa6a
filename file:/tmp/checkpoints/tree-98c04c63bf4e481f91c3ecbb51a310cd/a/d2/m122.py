x122