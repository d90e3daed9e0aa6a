x518