x271