x987