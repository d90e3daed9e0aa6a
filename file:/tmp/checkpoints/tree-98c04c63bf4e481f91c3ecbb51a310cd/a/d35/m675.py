x675