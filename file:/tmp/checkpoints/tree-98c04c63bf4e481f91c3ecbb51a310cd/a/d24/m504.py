x504