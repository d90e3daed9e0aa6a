x888