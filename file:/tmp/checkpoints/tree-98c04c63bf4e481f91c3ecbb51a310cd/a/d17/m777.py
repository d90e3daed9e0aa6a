x777