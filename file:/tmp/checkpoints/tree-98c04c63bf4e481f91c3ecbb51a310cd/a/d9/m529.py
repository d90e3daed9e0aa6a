x529