x995