x933