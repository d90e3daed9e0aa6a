x270