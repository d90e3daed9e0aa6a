x866